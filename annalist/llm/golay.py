"""SimHash near-duplicates found through the Golay code.

A 64-bit fingerprint is cut into three segments, each read as a word of the perfect (23, 12)
Golay code: every word lies within three bits of exactly one codeword, whose 12-bit index is
the word's own key. A word that differs from it by ``e`` bits finds that codeword among all
codewords within ``3 + e`` bits of itself, so it probes with several keys.

With at most four differing bits over three segments, one of these holds:

* a segment is equal, and one of the two others differs by at most two bits: the key is the
  equal segment as it is and a codeword index of the other one;
* every segment differs, and then two of them by exactly one bit each: the key is the codeword
  indexes and parities of these two. One bit flips the parity, so only even words probe.

Keys are joined, each candidate pair is verified by its differing bits inside the join, and
the pairs' components give the groups. Only distinct fingerprints take part, so copies cost
nothing. No key is capped.

Defined cases: null text has no words; no words give fingerprint zero, linked like any other;
equal rows share a group; a null id is never a group's id unless the group has no other; an
empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from annalist.llm import common
from annalist.llm.components import components

DISTANCE = 4
SEED = 42
# Lowest bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Generator polynomial of the code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
PARITY_BITS = 11
# Shingle hashes added up at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, size: int = 4) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit number."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - size + 1, 1)
    span = zip(starts[:last].tolist(), ends[min(size, len(words)) - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in span], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, last, BLOCK):
        part = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """``doc_id, fp`` of every row."""
    common.ship(docs.sparkSession)
    source = common.text_column(docs)
    key = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = [fingerprint(x, size) for x in common.raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {key}, fp long")


@lru_cache(maxsize=1)
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of 23-bit words, and per syndrome the error patterns of up to five bits.

    Returns the syndrome of the low 12 and high 11 bits of a word, the patterns grouped by
    syndrome and sorted by weight, and where each syndrome's patterns begin, for weights up
    to 3, 4 and 5 (columns 1 to 3; column 0 is the begin).
    """
    unit = []
    for bit in range(23):
        word = 1 << bit
        for top in range(22, PARITY_BITS - 1, -1):
            if word >> top & 1:
                word ^= GENERATOR << top - PARITY_BITS
        unit.append(word)

    def table(units: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for u in units:
            out = np.concatenate([out, out ^ u])
        return out

    low, high = table(unit[:12]), table(unit[12:])
    patterns, syndromes, weights = [], [], []
    for weight in range(6):
        for bits in combinations(range(23), weight):
            patterns.append(sum(1 << b for b in bits))
            syndromes.append(int(np.bitwise_xor.reduce([unit[b] for b in bits])) if bits else 0)
            weights.append(weight)
    order = np.lexsort((weights, syndromes))
    patterns = np.array(patterns, np.int64)[order]
    syndromes, weights = np.array(syndromes)[order], np.array(weights)[order]
    begins = np.searchsorted(syndromes, np.arange(2048))
    ends = [begins + np.bincount(syndromes[weights <= w], minlength=2048) for w in (3, 4, 5)]
    return low, high, patterns, np.stack([begins, *ends], 1)


def nearby(words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the codewords within ``most`` bits (3 to 5) of words, and whose word each is for."""
    low, high, patterns, ranges = _code()
    syndrome = low[words & 0xFFF] ^ high[words >> 12]
    begin = ranges[syndrome, 0]
    sizes = ranges[syndrome, most - 2] - begin
    owner = np.repeat(np.arange(len(words)), sizes)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return (words[owner] ^ patterns[begin[owner] + within]) >> PARITY_BITS, owner


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    bits = fps.view(np.uint64)
    return [((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]


def own_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys a fingerprint is found by, and the row each is for. An even key is of the first kind."""
    parts = _segments(fps)
    index = [nearby(p, 3)[0] for p in parts]
    odd = [np.bitwise_count(p).astype(np.int64) & 1 for p in parts]
    keys = []
    for i in range(3):
        for j in range(3):
            if i != j:
                keys.append(_equal_key(i, j, parts[i], index[j]))
    for i, j in combinations(range(3), 2):
        keys.append(_odd_key(i, j, index[i], index[j], odd[i], odd[j]))
    return np.concatenate(keys), np.tile(np.arange(len(fps)), len(keys))


def probe_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a fingerprint looks for others, and the row each is for."""
    parts = _segments(fps)
    odd = [np.bitwise_count(p).astype(np.int64) & 1 for p in parts]
    wide = [nearby(p, 5) for p in parts]
    keys, owners = [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                codes, owner = wide[j]
                keys.append(_equal_key(i, j, parts[i][owner], codes))
                owners.append(owner)
    near = [nearby(p, 4) for p in parts]
    for i, j in combinations(range(3), 2):
        even = np.flatnonzero(odd[i] == 0)
        first, one = nearby(parts[i][even], 4)
        codes, owner = near[j]
        begin = np.searchsorted(owner, np.arange(len(fps) + 1))
        rows = even[one]
        sizes = begin[rows + 1] - begin[rows]
        pick = np.repeat(np.arange(len(rows)), sizes)
        place = begin[rows[pick]] + np.arange(len(pick)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row = rows[pick]
        keys.append(_odd_key(i, j, first[pick], codes[place], 1 - odd[i][row], 1 - odd[j][row]))
        owners.append(row)
    return np.concatenate(keys), np.concatenate(owners)


def _equal_key(i: int, j: int, whole: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (((i * 3 + j) << 34 | whole << 12 | code) << 1).astype(np.int64)


def _odd_key(i: int, j: int, first: np.ndarray, second: np.ndarray, odd_i: np.ndarray, odd_j: np.ndarray) -> np.ndarray:
    return (((i * 3 + j) << 34 | odd_i << 25 | odd_j << 24 | first << 12 | second) << 1 | 1).astype(np.int64)


def _keyed(fps: DataFrame, keys, name: str) -> DataFrame:
    """Rows ``key, name`` for each key of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                values = batch.column(0)[at : at + 2000].to_numpy(zero_copy_only=False)
                found, owner = keys(values)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(values[owner])], ["key", name])

    return fps.mapInArrow(run, f"key long, {name} long")


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """All pairs ``a, b`` of distinct values in ``fp`` with up to ``distance`` (at most 4) differing bits."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the keys cover up to {DISTANCE} bits")
    probes, owners = _keyed(fps, probe_keys, "p"), _keyed(fps, own_keys, "q")
    differ = F.bit_count(F.col("p").bitwiseXOR(F.col("q")))
    verified = (differ <= distance) & (((F.col("o.key") % 2 == 0) & (F.col("p") < F.col("q"))) | (F.col("o.key") % 2 == 1))
    pairs = probes.alias("r").join(owners.alias("o"), (F.col("r.key") == F.col("o.key")) & verified)
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _rooted(rows: DataFrame, distance: int) -> DataFrame:
    """``fp, least, root`` of each distinct fingerprint: its least id and its group's least fingerprint."""
    nodes = common.stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = components(links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, size: int = 4, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the least id that links reach, its own included."""
    rows = common.stage(fingerprints(docs, size), "fingerprints")
    named = _rooted(rows, distance)
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.select("fp", "root").join(heads, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")


#: Rows to leave out are sent to all executors up to this number, else joined by shuffle.
MOST_DROPPED = 2_000_000


def marks() -> list[Column]:
    """Two hashes of id and text that tell rows apart."""
    return [F.xxhash64("doc_id", "text").alias("_m1"), F.xxhash64("text", "doc_id").alias("_m2")]


def drop_near_duplicates(docs: DataFrame, size: int = 4, distance: int = DISTANCE) -> DataFrame:
    """One row of each group, with all its columns: that of the least id, null last.

    Rows are told apart by two hashes of id and text; of rows equal in both, one stays.
    """
    keyed = docs.select("doc_id", "text", F.struct(*marks()).alias("mark"))
    rows = common.stage(_marked(keyed, size), "fingerprints")
    return keep_first(docs, rows, _rooted(rows, distance).select("fp", "root"))


def keep_first(docs: DataFrame, rows: DataFrame, named: DataFrame) -> DataFrame:
    """The first row of each group, from ``doc_id, mark, fp`` of every row and ``fp, root``."""
    ranked = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    first = rows.groupBy("fp").agg(F.min(ranked).alias("first"), F.count("*").alias("n"))
    best = first.join(named, "fp").groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("n"))
    groups = best.where("n > 1").select("root", F.col("best.mark").alias("kept"))
    members = rows.join(named, "fp").join(groups, "root").select("mark", "kept")
    dropped = common.stage(members.where("mark <> kept").select("mark._m1", "mark._m2").distinct(), "near-dropped")
    twice = members.where("mark = kept").groupBy("mark").count().where("count > 1").select("mark._m1", "mark._m2")
    twice = common.stage(twice, "near-twice")
    spark, names = docs.sparkSession, [common.named(c) for c in docs.columns]
    left = docs.select(F.struct(*names).alias("row"), *marks())
    left = left.join(common.by_size(spark, dropped, MOST_DROPPED), ["_m1", "_m2"], "left_anti")
    if twice.count():
        twice = common.by_size(spark, twice, MOST_DROPPED)
        once = left.join(twice, ["_m1", "_m2"], "left_semi").dropDuplicates(["_m1", "_m2"])
        left = left.join(twice, ["_m1", "_m2"], "left_anti").unionByName(once)
    return left.select("row.*")


def _marked(keyed: DataFrame, size: int) -> DataFrame:
    """``doc_id, mark, fp`` of every row."""
    common.ship(keyed.sparkSession)
    kinds = [f"{c} {keyed.schema[c].dataType.simpleString()}" for c in ("doc_id", "mark")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = pa.array([fingerprint(x, size) for x in common.raw_texts(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), found], ["doc_id", "mark", "fp"])

    return keyed.mapInArrow(run, ", ".join([*kinds, "fp long"]))
