"""Alignment of two tokenizers on whole texts by lockstep merging.

Tokenizer A is a byte-level vocabulary, B a sentence-piece model. Of each text both give tokens
with their end in bytes. One NumPy state vector holds a pointer into A's and one into B's tokens
for every lane of a batch; each step compares the two ends of all lanes at once, advances the
pointer that is behind (both where they meet), puts out a link and a cut where they meet, and
compacts lanes that are done. A lane is a document, or ``LANE`` bytes of a longer one: its pointers
start at the first tokens that end inside it, so every meeting point belongs to one lane and the
number of steps does not grow with the longest text.

Two tokens that end together have bytes of which one is the end of the other, so the id pairs that
can ever be linked are fixed by the two vocabularies: ``Pairs`` lists them (some hundred thousand
here), links are stored as numbers in that list, and the counts of all pairs are an array of fixed
size, at any size of the corpus. They are summed with partial sums and sent to the workers.

Defined cases: null and empty texts, and texts that either tokenizer does not give back byte for
byte, have no tokens, zeros and an empty ``groups``; equal rows are aligned one by one and all
their links count; links of equal count are all best; an empty table gives no rows; other columns
are left out. A very long text is encoded at once and walked in many lanes.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annalist.llm import common
from annalist.llm.tokens import LETTERS

# Bytes of a text that one lane walks: a matter of speed only.
LANE = 2_048

_known: dict[tuple[str, str], "Aligner"] = {}
common.KEPT["alignment"] = _known.clear


class Bytes:
    """The bytes of every id of a vocabulary, and their lengths."""

    def __init__(self, pieces: dict[int, bytes]):
        self.of = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.length = np.array([len(x) for x in self.of], np.int64)


class ByteLevel:
    """Tokenizer A: a byte-level byte-pair vocabulary, special strings read as plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, value = spec["model"]["vocab"], {x: b for b, x in enumerate(LETTERS)}
        own = {i: bytes(map(value.__getitem__, x)) for x, i in vocab.items()}
        self.bytes = Bytes(own | {x["id"]: x["content"].encode() for x in spec["added_tokens"]})
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        # Where each merge makes the next id, ids are ranks and the faster encoder gives the same.
        self.fast = None
        if [vocab[a + b] for a, b in merges] == list(range(len(LETTERS), len(vocab))) and spec["normalizer"] is None:
            import public_tokenizers

            ranks = {b: i for i, b in own.items()}
            self.fast = tiktoken.Encoding("alignment", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.assigned: dict[str, bool] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        fast = [self.fast is not None and self._plain(t) for t in texts]
        slow = iter(self.tokenizer.encode_batch_fast([t for t, f in zip(texts, fast) if not f], add_special_tokens=False))
        return [self.fast.encode_ordinary(t) if f else next(slow).ids for t, f in zip(texts, fast)]

    def _plain(self, text: str) -> bool:
        """Whether both encoders know all characters: younger ones may be letters to one alone."""
        if text.isascii():
            return True
        letters = set(text)
        for c in letters.difference(self.assigned):
            self.assigned[c] = unicodedata.category(c) != "Cn"
        return all(map(self.assigned.__getitem__, letters))


class SentencePiece:
    """Tokenizer B: a sentence-piece model; its spaces are U+2581, single bytes <0xHH>."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            pieces[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
        self.bytes = Bytes(pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Pairs:
    """All pairs of ids of which one's bytes are the end of the other's, in order of A, then B."""

    def __init__(self, a: Bytes, b: Bytes):
        keys = []
        for one, other, turned in ((a, b, False), (b, a, True)):
            ids: dict[bytes, list[int]] = {}
            for i, x in enumerate(other.of):
                if x:
                    ids.setdefault(x, []).append(i)
            for i, x in enumerate(one.of):
                for cut in range(len(x)):
                    for j in ids.get(x[cut:], ()):
                        keys.append(j << 32 | i if turned else i << 32 | j)
        self.keys = np.unique(np.array(keys, np.int64))

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a.astype(np.int64) << 32 | b).astype(np.int32)

    def b(self) -> np.ndarray:
        return self.keys & 0xFFFFFFFF


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A's and B's tokens that end together, in order; one entry of ``a``, ``b``, ``stop`` a lane.

    ``a`` and ``b`` point at the first token of a lane, ``stop`` is the byte where the lane ends;
    the ends of both sides rise, and both have one there or beyond.
    """
    a, b, met_a, met_b = a.copy(), b.copy(), [], []
    while len(a):
        ends_a, ends_b = a_end[a], b_end[b]
        nearest = np.minimum(ends_a, ends_b)
        hit = (ends_a == ends_b) & (nearest <= stop)
        met_a.append(a[hit])
        met_b.append(b[hit])
        a += ends_a <= ends_b
        b += ends_b <= ends_a
        # A lane is done when no side has an end left before its last byte.
        on = nearest < stop
        if not on.all():
            a, b, stop = a[on], b[on], stop[on]
    found_a = np.concatenate(met_a) if met_a else np.zeros(0, np.int64)
    found_b = np.concatenate(met_b) if met_b else np.zeros(0, np.int64)
    order = np.argsort(found_a, kind="stable")
    return found_a[order], found_b[order]


class Digits:
    """Decimal texts of ids, as rows of a byte table with one more place for a separator."""

    def __init__(self, ids: int):
        self.width = len(str(ids - 1))
        texts = [str(i).encode() for i in range(ids)]
        self.table = np.frombuffer(b"".join(x.ljust(self.width + 1, b"\0") for x in texts), np.uint8).reshape(ids, -1)
        self.length = np.array([len(x) for x in texts], np.int64)


class Aligner:
    """Both tokenizers and the pairs that they can link."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a), SentencePiece(b)
        self.pairs = Pairs(self.a.bytes, self.b.bytes)
        self.digits = Digits(max(len(self.a.bytes.of), len(self.b.bytes.of)))

    @classmethod
    def of(cls, a: str, b: str) -> "Aligner":
        if (a, b) not in _known:
            _known[a, b] = cls(a, b)
        return _known[a, b]

    def align(self, texts: list[bytes]) -> list[tuple[int, int, int, np.ndarray, bytes]]:
        """Of each text: tokens of A, of B, groups, the numbers of its linked pairs, its groups as text."""
        out: list = [(0, 0, 0, np.zeros(0, np.int32), b"")] * len(texts)
        rows, plain = [], []
        for row, text in enumerate(texts):
            if text:
                rows.append(row)
                plain.append(text.decode(errors="replace"))
        good, ids_a, ids_b = [], [], []
        for row, x, y in zip(rows, self.a.encode([" " + t for t in plain]), self.b.encode(plain)):
            whole = b" " + texts[row]
            if b"".join(map(self.a.bytes.of.__getitem__, x)) == whole == b"".join(map(self.b.bytes.of.__getitem__, y)):
                good.append(row)
                ids_a.append(np.array(x, np.int32))
                ids_b.append(np.array(y, np.int32))
        if not good:
            return out
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        # All texts lie end to end, so that ends rise over the whole batch.
        a_end, b_end = np.cumsum(self.a.bytes.length[a]), np.cumsum(self.b.bytes.length[b])
        last = a_end[np.cumsum(n_a) - 1]
        first = np.r_[0, last[:-1]]
        lanes = np.maximum(-(-(last - first) // LANE), 1)
        within = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = np.repeat(first, lanes) + within * LANE
        stop = np.minimum(begin + LANE, np.repeat(last, lanes))
        at_a, at_b = np.searchsorted(a_end, begin, "right"), np.searchsorted(b_end, begin, "right")
        met_a, met_b = lockstep(a_end, b_end, at_a, at_b, stop)
        linked = self.pairs.number(a[met_a], b[met_b])
        text, ends = self._groups(a, b, met_a, met_b, np.cumsum(n_a) - 1)
        link_ends = np.searchsorted(met_a, np.cumsum(n_a) - 1, "right")
        starts, link_starts = np.r_[0, ends[:-1]], np.r_[0, link_ends[:-1]]
        for k, row in enumerate(good):
            own = linked[link_starts[k] : link_ends[k]]
            out[row] = (int(n_a[k]), int(n_b[k]), len(own), own, text[starts[k] : ends[k] - 1])
        return out

    def _groups(self, a: np.ndarray, b: np.ndarray, met_a: np.ndarray, met_b: np.ndarray, last: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All groups as one text, ids with the sign that follows each, and where each document ends in it."""
        group_a = np.searchsorted(met_a, np.arange(len(a)))
        group_b = np.searchsorted(met_b, np.arange(len(b)))
        # Tokens in the order of the text: A's of a group, then B's.
        first_b = np.r_[0, met_b[:-1] + 1]
        place_a = np.arange(len(a)) + first_b[group_a]
        place_b = np.arange(len(b)) + met_a[group_b] + 1
        ids = np.empty(len(a) + len(b), np.int32)
        ids[place_a], ids[place_b] = a, b
        sign = np.full(len(ids), ord(","), np.uint8)
        sign[place_a[met_a]] = ord("|")
        sign[place_b[met_b]] = ord(";")
        rows = self.digits.table[ids]
        length = self.digits.length[ids]
        rows[np.arange(len(ids)), length] = sign
        text = rows[np.arange(self.digits.width + 1) <= length[:, None]].tobytes()
        # A document's last token in this order is B's last of the group of A's last.
        closing = place_b[met_b[np.searchsorted(met_a, last)]]
        return text, np.cumsum(length + 1)[closing]


def align(docs: DataFrame, a: str, b: str, keep_groups: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's counts, the SHA-256 of its groups, and the numbers of its linked pairs.

    ``links`` holds little-endian 32-bit numbers of pairs in ``Pairs``, in the order of the text.
    ``keep_groups`` adds the groups as text.
    """
    common.ship(docs.sparkSession)
    source = common.text_column(docs, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(a, b)
        for batch in common.slices(batches, keep="alignment"):
            found = aligner.align(common.raw_texts(batch))
            columns = [
                batch.column("doc_id"),
                *(pa.array([x[i] for x in found], pa.int64()) for i in (0, 1, 2)),
                pa.array([len(x[3]) for x in found], pa.int64()),
                pa.array([hashlib.sha256(x[4]).hexdigest() if x[4] else "" for x in found], pa.string()),
                pa.array([x[3].astype("<i4").tobytes() for x in found], pa.binary()),
                pa.array([x[4].decode() if keep_groups else None for x in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "groups"])

    out = source.mapInArrow(
        run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, groups string"
    )
    return out if keep_groups else out.drop("groups")


def pair_counts(aligned: DataFrame, a: str, b: str) -> DataFrame:
    """How many links of all documents hold each id pair: ``pair``, ``a_id``, ``b_id``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("links").to_pylist()), "<i4")
            counts = np.zeros(0, np.int64) if counts is None else counts
            more = np.bincount(flat, minlength=len(counts))
            more[: len(counts)] += counts
            counts = more
        if counts is not None:
            there = np.flatnonzero(counts)
            keys = Aligner.of(a, b).pairs.keys[there]
            arrays = (there, keys >> 32, keys & 0xFFFFFFFF, counts[there])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["pair", "a_id", "b_id", "n"])

    parts = aligned.select("links").mapInArrow(run, "pair long, a_id long, b_id long, n long")
    return parts.groupBy("pair", "a_id", "b_id").agg(F.sum("n").alias("n"))


def judge(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``align`` with ``n_best`` and ``count_sum`` from the pair counts of all documents."""
    spark = docs.sparkSession
    aligned = common.stage(align(docs, a, b), "aligned")
    # One row for each pair of a list that the vocabularies fix, whatever the corpus.
    size = len(Aligner.of(a, b).pairs.keys)
    own_b = Aligner.of(a, b).pairs.b()
    counts = np.zeros(size, np.int64)
    found = pair_counts(aligned, a, b).select("pair", "n").toArrow()
    counts[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    most = np.zeros(int(own_b.max()) + 1, np.int64)
    np.maximum.at(most, own_b, counts)
    best = counts == most[own_b]
    shared = spark.sparkContext.broadcast((counts, best))
    _known.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            n_best, sums = [], []
            for data in batch.column("links").to_pylist():
                own = np.frombuffer(data, "<i4")
                n_best.append(int(best[own].sum()))
                sums.append(int(counts[own].sum()))
            names = [x for x in batch.schema.names if x != "links"]
            columns = [batch.column(x) for x in names] + [pa.array(n_best, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names + ["n_best", "count_sum"])

    kind = aligned.schema["doc_id"].dataType.simpleString()
    return aligned.mapInArrow(
        run,
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long",
    )
