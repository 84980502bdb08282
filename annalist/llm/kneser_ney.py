"""Interpolated modified Kneser-Ney bigram model, counted in Spark and read by memory mapping.

Tokens are lower-cased words and one end per text; each is known by a 64-bit hash. Tasks count
pairs of neighbours over blocks of text and pack the counts into byte blocks, one per range of
the pair hash. Spark shuffles the blocks, and the counts of a range are merged and written as
sorted arrays to the shared folder: a sharded model that grows with the corpus. The words'
own figures (how often, after how many different words, before how many with 1, 2 and more
occurrences) are merged in the same way by ranges of the word hash. Ranges have a bounded
size, so their number grows with the corpus. Frequent words do no harm: pairs are spread by
the hash of the pair, and words are summed before they are shuffled.

Scoring maps the arrays into memory, so that workers of a machine share its page cache, and
looks up the sorted distinct pairs of a block of text in them.

Defined cases: null text is empty, an empty text is its end alone; equal rows count each; an
empty training part gives every token probability one; null ids count as the empty text in
the split; other columns are left out.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from annalist.llm import common, hashing
from annalist.llm.hashing import mix
from annalist.sources import shared

#: Bytes of counts in one range, about.
RANGE_BYTES = 24_000_000
#: Tokens counted in memory before a task passes them on.
BLOCK_TOKENS = 1_500_000

_M = np.uint64
START, END = _M(1), _M(2)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, none of them small."""
    return np.maximum(hashing.word_hashes(words), _M(16))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Preceding token, token, and the number of tokens of each text."""
    split = [t.lower().split() for t in texts]
    sizes = np.fromiter((len(w) + 1 for w in split), np.int64, len(split))
    hashes = word_hashes([w for words in split for w in words])
    total = int(sizes.sum())
    ends = np.cumsum(sizes) - 1
    is_end = np.zeros(total, bool)
    is_end[ends] = True
    now = np.empty(total, np.uint64)
    now[is_end], now[~is_end] = END, hashes
    before = np.empty(total, np.uint64)
    before[1:] = now[:-1]
    before[np.concatenate([[0], ends[:-1] + 1])] = START
    return before, now, sizes


def pair_hash(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return mix(mix(before * hashing.STEP) ^ now)


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash: ranges of equal width in the order of the hashes."""
    return (((hashes >> _M(32)) * _M(ranges)) >> _M(32)).astype(np.int64)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, byte by byte, so that equal high bytes compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: memoryview, count: int, width: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, count).T
    return out.reshape(-1).view("<u8")


class Blocks:
    """Rows of numbers of fixed widths, packed per range."""

    def __init__(self, *widths: int):
        self.widths = widths

    def pack(self, *columns: np.ndarray) -> bytes:
        return b"".join(_planes(c, w) for c, w in zip(columns, self.widths))

    def unpack(self, data: bytes) -> list[np.ndarray]:
        count = len(data) // sum(self.widths)
        view, at, out = memoryview(data), 0, []
        for width in self.widths:
            out.append(_numbers(view[at : at + count * width], count, width))
            at += count * width
        return out

    def merge(self, blocks: list[bytes]) -> list[np.ndarray]:
        parts = [self.unpack(b) for b in blocks]
        return [np.concatenate(c) for c in zip(*parts)]

    def deal(self, ranges: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
        """Sorted rows cut where the range changes."""
        cuts = np.flatnonzero(np.diff(ranges)) + 1
        starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(ranges)]
        if not len(ranges):
            return [], []
        return ranges[starts].tolist(), [self.pack(*(c[a:b] for c in columns)) for a, b in zip(starts, ends)]


PAIRS = Blocks(8, 8, 4)
WORDS = Blocks(8, 5, 5, 4, 4, 4)
BLOCK_SCHEMA = "part int, data binary"


def _combine(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys and where each distinct one begins in it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else order
    return order, first


def _count_pairs(befores: list, nows: list, ranges: int) -> pa.RecordBatch:
    before, now = np.concatenate(befores), np.concatenate(nows)
    keys = pair_hash(before, now)
    order, first = _combine(keys)
    counts = np.diff(np.append(first, len(order))).astype(np.uint64)
    at = order[first]
    before, now, part = before[at], now[at], range_of(keys[at], ranges)
    # Within a range by the word before, whose bytes then compress.
    again = np.lexsort((before, part))
    parts, data = PAIRS.deal(part[again], before[again], now[again], counts[again])
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])


@dataclass
class Model:
    """Where the arrays are, and the few numbers that hold for all of them."""

    path: str
    ranges: int
    tokens: int
    words: int
    pairs: int
    discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_rest: float


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts of the modified method from the numbers of things seen 1 to 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.0
    found = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.0 for k in range(3)]
    return tuple(min(max(d, 0.0), k + 1.0) for k, d in enumerate(found))


def train(docs: DataFrame, used: Column | None = None) -> Model:
    """Count the model over the rows for which ``used`` holds and write its arrays."""
    spark = docs.sparkSession
    common.ship(spark)
    source = common.text_column(docs)
    if used is not None:
        source = source.where(used)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About 6 bytes a token, 20 bytes a count.
    ranges = max(1, -(-size * 20 // (6 * RANGE_BYTES)))
    path = shared.folder(spark, "kneser-ney")
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(
        spark._jvm.org.apache.hadoop.fs.Path(path)
    )

    names = ["kind", "figures"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        befores, nows, held = [], [], 0
        for batch in common.slices(batches):
            before, now, _ = tokens(common.raw_texts(batch))
            befores.append(before)
            nows.append(now)
            held += len(now)
            if held >= BLOCK_TOKENS:
                yield _count_pairs(befores, nows, ranges)
                befores, nows, held = [], [], 0
        if held:
            yield _count_pairs(befores, nows, ranges)

    def merge_pairs(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        before, now, counts = PAIRS.merge(table.column("data").to_pylist())
        keys = pair_hash(before, now)
        order, first = _combine(keys)
        counts = np.add.reduceat(counts[order], first)
        at = order[first]
        before, now, keys = before[at], now[at], keys[at]
        large = np.flatnonzero(counts >= 255)
        common.publish(f"{path}/pair-{part}.hash", keys.astype("<u8").tobytes())
        common.publish(f"{path}/pair-{part}.count", np.minimum(counts, 255).astype(np.uint8).tobytes())
        common.publish(f"{path}/pair-{part}.large", np.stack([large.astype("<u8"), counts[large]]).tobytes())
        summary = np.array([np.count_nonzero(counts == k) for k in (1, 2, 3, 4)] + [len(counts)], np.uint64)
        # Per word: hash, its count, words before it, and what follows it once, twice, more often.
        words = np.concatenate([before, now])
        order, first = _combine(words)
        zero = np.zeros_like(counts)
        one = np.ones_like(counts)
        columns = [
            np.concatenate([zero, counts]),
            np.concatenate([zero, one]),
            *(np.concatenate([hit.astype(np.uint64), zero]) for hit in (counts == 1, counts == 2, counts > 2)),
        ]
        sums = [np.add.reduceat(c[order], first) for c in columns]
        words = words[order[first]]
        parts, data = WORDS.deal(range_of(words, ranges), words, *sums)
        return pa.table([pa.array([*parts, -1], pa.int32()), pa.array([*data, summary.tobytes()], pa.binary())], ["part", "data"])

    def merge_words(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part < 0:
            total = sum(np.frombuffer(x, np.uint64).astype(object) for x in table.column("data").to_pylist())
            return pa.table([["pairs"], [[int(x) for x in total]]], names)
        columns = WORDS.merge(table.column("data").to_pylist())
        order, first = _combine(columns[0])
        words = columns[0][order[first]]
        sums = [np.add.reduceat(c[order], first) for c in columns[1:]]
        common.publish(f"{path}/word-{part}.hash", words.astype("<u8").tobytes())
        common.publish(f"{path}/word-{part}.count", sums[0].astype("<u8").tobytes())
        common.publish(f"{path}/word-{part}.kinds", np.stack([s.astype("<u4") for s in sums[1:]], 1).tobytes())
        after = sums[1]
        figures = [np.count_nonzero(after == k) for k in (1, 2, 3, 4)] + [np.count_nonzero(after), int(sums[0].sum())]
        return pa.table([["words"], [[int(x) for x in figures]]], names)

    # As many tasks as ranges, so that a task holds few of them at any size of the corpus.
    counted = source.mapInArrow(count, BLOCK_SCHEMA).repartition(ranges, "part")
    merged = counted.groupBy("part").applyInArrow(merge_pairs, BLOCK_SCHEMA).repartition(ranges, "part")
    figures = merged.groupBy("part").applyInArrow(merge_words, "kind string, figures array<long>")
    sums = figures.select("kind", F.posexplode("figures")).groupBy("kind", "pos").agg(F.sum("col").alias("n")).collect()
    found = {(r["kind"], r["pos"]): r["n"] for r in sums}
    n_pairs = [found.get(("pairs", k), 0) for k in range(5)]
    n_words = [found.get(("words", k), 0) for k in range(6)]
    d = _discounts(n_words[:4])
    one, two = n_words[0], n_words[1]
    more = n_words[4] - one - two
    rest = (d[0] * one + d[1] * two + d[2] * more) / n_pairs[4] if n_pairs[4] else 1.0
    return Model(path, ranges, n_words[5], n_words[4], n_pairs[4], _discounts(n_pairs[:4]), d, rest)


class Reader:
    """The arrays of a model, mapped into memory range by range."""

    def __init__(self, model: Model):
        self.model, self.maps = model, {}
        self.folder = None

    def _map(self, name: str, kind: str) -> np.ndarray:
        if name not in self.maps:
            from pyarrow import fs

            system, place = fs.FileSystem.from_uri(f"{self.model.path}/{name}")
            info = system.get_file_info(place)
            if info.type == fs.FileType.NotFound or not info.size:
                self.maps[name] = np.zeros(0, kind)
            else:
                if not isinstance(system, fs.LocalFileSystem):
                    place = self._fetch(system, place, name)
                self.maps[name] = np.memmap(place, kind, "r")
        return self.maps[name]

    def _fetch(self, system, place: str, name: str) -> str:
        """A store that cannot be mapped is copied beside the worker, which removes it at its end."""
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="kneser-ney-")
        local = os.path.join(self.folder.name, f"{name}-{uuid.uuid4().hex}")
        with system.open_input_stream(place) as source, open(local, "wb") as out:
            while chunk := source.read(1 << 24):
                out.write(chunk)
        return local

    def _find(self, kind: str, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each range: its number, the queries found there and their places. Hashes are sorted."""
        part = range_of(hashes, self.model.ranges)
        edges = np.searchsorted(part, np.arange(self.model.ranges + 1))
        for number in np.unique(part).tolist():
            keys = self._map(f"{kind}-{number}.hash", "<u8")
            if not len(keys):
                continue
            query = hashes[edges[number] : edges[number + 1]]
            at = np.minimum(np.searchsorted(keys, query), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == query)
            yield number, edges[number] + hit, at[hit]

    def pairs(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of pairs by sorted hash."""
        out = np.zeros(len(hashes), np.float64)
        for number, rows, at in self._find("pair", hashes):
            counts = self._map(f"pair-{number}.count", np.uint8)[at].astype(np.float64)
            large = self._map(f"pair-{number}.large", "<u8")
            if len(large):
                places, values = large.reshape(2, -1)
                where = np.flatnonzero(counts == 255)
                counts[where] = values[np.searchsorted(places, at[where])]
            out[rows] = counts
        return out

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count, and words before and kinds of what follows, of words by sorted hash."""
        count, kinds = np.zeros(len(hashes), np.float64), np.zeros((len(hashes), 4), np.float64)
        for number, rows, at in self._find("word", hashes):
            count[rows] = self._map(f"word-{number}.count", "<u8")[at]
            kinds[rows] = self._map(f"word-{number}.kinds", "<u4").reshape(-1, 4)[at]
        return count, kinds

    def probabilities(self, before: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each token after the one before it, and the token's count in training."""
        m = self.model
        words, place = np.unique(np.concatenate([before, now]), return_inverse=True)
        count, kinds = self.words(words)
        rows, column = place[: len(before)], place[len(before) :]
        keys, pair = np.unique(pair_hash(before, now), return_inverse=True)
        seen = self.pairs(keys)[pair]
        preceded = kinds[:, 0]
        cut = np.array([0.0, *m.word_discounts])[np.minimum(preceded, 3).astype(int)]
        unigram = ((preceded - cut) / m.pairs if m.pairs else 0.0 * preceded) + m.word_rest / (m.words + 1)
        following = kinds[:, 1:]
        # How often a word was followed by anything: its discounted kinds carry the rest.
        contexts = self.context_totals(words, count)
        safe = np.maximum(contexts, 1)
        rest = np.where(contexts > 0, following @ np.array(m.discounts) / safe, 1.0)
        cut = np.array([0.0, *m.discounts])[np.minimum(seen, 3).astype(int)]
        return (seen - cut) / safe[rows] + rest[rows] * unigram[column], count[column]

    def context_totals(self, words: np.ndarray, count: np.ndarray) -> np.ndarray:
        """A word is followed each time it occurs; a start is as frequent as an end."""
        out = count.copy()
        out[words == END] = 0
        at = np.flatnonzero(words == START)
        if len(at):
            out[at] = self.words(np.array([END], np.uint64))[0][0]
        return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every row, in log10."""
    common.ship(docs.sparkSession)
    source = common.text_column(docs)
    key = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        share = model.tokens + 0.5 * (model.words + 1)
        for batch in common.slices(batches):
            before, now, sizes = tokens(common.raw_texts(batch))
            found, count = reader.probabilities(before, now)
            starts = np.cumsum(sizes) - sizes
            base = np.log10((count + 0.5) / share)
            columns = [np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64), base, np.log10(found))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), *map(pa.array, columns)],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return source.mapInArrow(run, f"doc_id {key}, n_tokens long, n_known long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """Add the perplexity of each text."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
