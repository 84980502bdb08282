"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Texts are lowered and everything but letters, digits and non-ASCII characters becomes one
space. A passage of ``m`` bytes that occurs with at most ``e`` edits shares at least
``m - q + 1 - q * e`` of its q-grams with the document, on at most ``e + 1`` neighbouring
diagonals. Shared q-grams are counted in bands of ``2 * (e + 1)`` diagonals that overlap by
half, so some band holds them all; bands below the bound cannot hold a match, and the rest is
verified by an alignment that is confined to the band.

The passages are a query set: they are taken in blocks of bounded size, and each block is
compared with all documents in one pass over them.

Defined cases: null text is empty and matches nothing; a passage shorter than ``q`` bytes after
normalisation has no q-gram and matches nothing; equal rows and equal passages each count;
empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annalist.llm import common

Q = 8
#: Edits allowed per byte of a passage.
RATE = 0.1
#: Bytes of passages in one block.
BLOCK_BYTES = 4_000_000
SPREAD = np.uint64(0x9E3779B97F4A7C15)

# Anything in ASCII that is neither a letter nor a digit becomes a space.
_PLAIN = bytes(x if x > 127 or chr(x).isalnum() else 32 for x in range(256))


def normalise(text: bytes) -> bytes:
    lowered = text.decode(errors="replace").lower().encode()
    return b" ".join(lowered.translate(_PLAIN).split())


def budget(length: int, rate: float = RATE, q: int = Q) -> int:
    """Edits allowed for a passage: as many as leave at least one shared q-gram."""
    return min(int(rate * length), (length - q) // q) if length >= q else -1


def grams(data: bytes) -> np.ndarray:
    """The 8-byte grams of a text as numbers, without copying it."""
    return np.ndarray((len(data) - Q + 1,), "<u8", data, strides=(1,))


class Index:
    """The q-grams of a block of passages: sorted, with passage and place, behind a bit table."""

    def __init__(self, items: list[tuple[object, bytes]], rate: float = RATE):
        self.items = [(key, data) for key, data in items if len(data) >= Q]
        sizes = np.array([len(d) for _, d in self.items], np.int64)
        self.edits = np.array([budget(n, rate) for n in sizes.tolist()], np.int64)
        self.least = sizes - Q + 1 - Q * self.edits
        parts = [grams(d) for _, d in self.items]
        values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else owner
        order = np.argsort(values, kind="stable")
        values, self.owner, self.place = values[order], owner[order], place[order]
        self.values, self.begin, self.count = np.unique(values, return_index=True, return_counts=True)
        self.shift = np.uint64(64 - max(16, int(len(self.values)).bit_length() + 5))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[(self.values * SPREAD) >> self.shift] = True

    def bands(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Passage and first diagonal of every band that holds enough shared q-grams."""
        if len(data) < Q or not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = grams(data)
        at = np.flatnonzero(self.table[(found * SPREAD) >> self.shift])
        found = found[at]
        index = np.minimum(np.searchsorted(self.values, found), len(self.values) - 1)
        equal = self.values[index] == found
        at, index = at[equal], index[equal]
        count = self.count[index]
        row = np.repeat(self.begin[index], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = self.owner[row]
        width = self.edits[item] + 1
        # Diagonals are shifted up so that none is negative.
        diagonal = np.repeat(at, count) - self.place[row] + (1 << 30)
        upper = diagonal // width
        key = item << 36 | upper
        keys, shared = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        item = keys >> 36
        good = shared >= self.least[item]
        item, band = item[good], keys[good] & (1 << 36) - 1
        return item, band * (self.edits[item] + 1) - (1 << 30)

    def matches(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """Text, passage, edits, begin and end of the best occurrence of each passage in each text.

        The texts are joined with gaps that no match can cross.
        """
        if not len(self.values):
            return []
        gap = b"\n" * (int(self.edits.max()) + 1)
        data = gap + gap.join(texts) + gap
        begins = np.cumsum([len(gap), *(len(t) + len(gap) for t in texts[:-1])])
        item, first = self.bands(data)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        inexact = []
        for i, f in zip(item.tolist(), first.tolist()):
            passage, edits = self.items[i][1], int(self.edits[i])
            low = max(f - edits, 0)
            at = data.find(passage, low, f + 3 * (edits + 1) + len(passage))
            if at >= 0:
                self._keep(best, begins, i, 0, at, at + len(passage))
            else:
                inexact.append((i, f))
        for at in range(0, len(inexact), 200):
            part = inexact[at : at + 200]
            passages = [self.items[i][1] for i, _ in part]
            edits = self.edits[[i for i, _ in part]]
            found = align(passages, data, np.array([f for _, f in part]), edits)
            for (i, f), edit, end, most in zip(part, *found, edits.tolist()):
                if edit <= most:
                    self._keep(best, begins, i, edit, max(f - most, 0), end)
        return [(row, i, *place) for (row, i), place in sorted(best.items())]

    @staticmethod
    def _keep(best: dict, begins: np.ndarray, item: int, edits: int, begin: int, end: int) -> None:
        row = int(np.searchsorted(begins, end - 1, "right")) - 1
        found = (edits, max(begin - int(begins[row]), 0), end - int(begins[row]))
        if (row, item) not in best or found < best[row, item]:
            best[row, item] = found


def align(passages: list[bytes], data: bytes, first: np.ndarray, edits: np.ndarray) -> tuple[list[int], list[int]]:
    """Least edits between each passage and any part of the text that begins in its band, and the end.

    A band has ``2 * (edits + 1)`` diagonals from ``first`` on; a path may leave it by ``edits``
    on each side. All alignments advance together, one row per byte of the passages; a running
    minimum carries insertions along a row.
    """
    sizes = np.array([len(p) for p in passages])
    letters = np.full((len(passages), sizes.max()), 256, np.int16)
    for i, p in enumerate(passages):
        letters[i, : len(p)] = np.frombuffer(p, np.uint8)
    low = first - edits
    cells = int((4 * edits + 3).max())
    column = np.arange(cells)[None, :]
    text = np.frombuffer(data, np.uint8)
    far = np.int32(1 << 28)
    start = low[:, None] + column
    outside = column >= (4 * edits + 3)[:, None]
    row = np.where(outside | (start < 0) | (start > len(text)), far, 0).astype(np.int32)
    for i in range(int(sizes.max())):
        at = start + i
        valid = (at >= 0) & (at < len(text))
        same = valid & (text[np.clip(at, 0, len(text) - 1)] == letters[:, i : i + 1])
        new = row + ~same
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new[outside | (at < -1) | (at >= len(text))] = far
        new = np.minimum.accumulate(new - column, axis=1) + column
        row = np.where((i < sizes)[:, None], new, row).astype(np.int32)
    row[outside] = far
    end = row.argmin(1)
    return row[np.arange(len(end)), end].tolist(), (low + sizes + end).tolist()


def blocks(benchmark: DataFrame, key: str, text: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[object, bytes]]]:
    """The passages in blocks of bounded size, one at a time on the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).toLocalIterator():
        data = normalise((row["t"] or "").encode())
        if block and size + len(data) > most:
            yield block
            block, size = [], 0
        block.append((row["k"], data))
        size += len(data)
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, item_key: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, edits, first_byte, last_byte`` for each passage in each document.

    Places are bytes of the normalised text; ``first_byte`` is exact for matches without edits,
    else the begin of the searched region.
    """
    spark = docs.sparkSession
    common.ship(spark)
    source = common.text_column(docs)
    kinds = source.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_key].dataType
    schema = f"doc_id {kinds[0]}, item_id {kinds[1].simpleString()}, edits int, first_byte long, last_byte long"
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(kinds[1])
    parts = []
    for block in blocks(benchmark, item_key, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, rate)
            for batch in common.slices(batches):
                texts = [normalise(x) for x in common.raw_texts(batch)]
                found = index.matches(texts)
                rows = [x[0] for x in found]
                found = [(index.items[x[1]][0], *x[2:]) for x in found]
                columns = list(zip(*found)) or [(), (), (), ()]
                kinds = (item_type, pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows, pa.int64()))]
                    + [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["doc_id", "item_id", "edits", "first_byte", "last_byte"],
                )

        parts.append(source.mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result


def clean(docs: DataFrame, benchmark: DataFrame, item_key: str = "item_id", item_text: str = "text", text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows in which no passage is found, with all their columns."""
    spark = docs.sparkSession
    common.ship(spark)
    names, wanted = common.plain_names(docs), docs.columns
    place = names[wanted.index(text)]
    docs = docs.toDF(*names)
    schema = docs.schema
    for block in blocks(benchmark, item_key, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, rate)
            for batch in common.slices(batches, place):
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in index.matches([normalise(x) for x in common.raw_texts(batch, place)]):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs.toDF(*wanted)
