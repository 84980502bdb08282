"""Near copies by word shingles: sets of five-word shingles with Jaccard similarity 0.8 or more.

Candidates are the rows that operator 4 links, by the Golay keys of their SimHash fingerprints
(``golay``), and beyond its four bits those that share one of ``BANDS`` keys, each made of ``ROWS`` minima of the shingle hashes under
random factors: a pair at similarity s is a candidate with probability 1 - (1 - s^5)^25, which is
0.99995 at 0.8 and more above. Every candidate is verified by its exact shingle sets.

Only distinct sets take part, so copies cost nothing. In each bucket of a key all members are
first compared with the least one. Buckets whose members are not one group by then go on: of the
small ones, up to ``SMALL`` members, the pairs are verified one by one. The members of a larger one
are dealt into chunks of bounded size, and each two chunks meet in a block of one task, which counts
the shared shingles of all its members by matrix products and puts out the links of a spanning
forest. So no pairs are put out within a group, no bucket is capped, and no link between groups is
lost. Links join to groups.

Defined cases: words are as in ``golay``; a text of fewer than five words has one shingle, all its
words; texts without words, null ones among them, are equal to each other and to nothing else;
of a group the row of the least id stays, a null id last, of equal ids one; an empty table gives
no rows; columns of any name pass through. A very long text is one set, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annalist.llm import common, golay, hashing
from annalist.llm.components import components

SIZE = 5
#: Least similarity of near copies, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 25, 5
# Shingles times factors at once.
BLOCK = 4096
# Members of a bucket whose pairs are verified one by one.
SMALL = 12
# Members and shingles of a chunk of a larger bucket, about.
CHUNK_ROWS, CHUNK_SHINGLES = 500, 500_000
# Shingles that are looked for in all members of a block at once.
SLAB = 2048
# Pairs of one set above which they are dealt, over how many copies, and the number of such sets
# that are sent to all executors.
OFTEN, PARTS, MOST_OFTEN = 200, 32, 1_000_000

_random = np.random.default_rng(11)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _random.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _random.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingles(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    split = [t.lower().split() for t in texts]
    hashes = hashing.word_hashes([w for words in split for w in words])
    grams = hashing.gram_hashes(hashes, size, size)
    out, at = [], 0
    for words in split:
        n = len(words)
        if n >= size:
            out.append(np.unique(grams[at : at + n - size + 1]))
        else:
            out.append(hashing.gram_hashes(hashes[at : at + n], n, n) if n else np.zeros(0, np.uint64))
        at += n
    return out


def digest(found: np.ndarray) -> int:
    """A number of a shingle set."""
    total = hashing.mix(found ^ hashing.STEP).sum(dtype=np.uint64) + np.uint64(len(found)) if len(found) else 0
    return int(np.array([total], np.uint64).view(np.int64)[0])


def band_keys(found: np.ndarray) -> np.ndarray:
    """The keys of a shingle set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), BLOCK):
        np.minimum(least, (found[at : at + BLOCK, None] * _FACTORS).min(0), out=least)
    return hashing.mix((hashing.mix(least).reshape(BANDS, ROWS) * _FOLD).sum(1, dtype=np.uint64) ^ _BAND).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have the least similarity."""
    up, down = LEAST
    if min(len(a), len(b)) * down < max(len(a), len(b)) * up:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * down >= (len(a) + len(b) - both) * up


def _sketched(keyed: DataFrame) -> DataFrame:
    """``doc_id, mark, fp, n, keys, simhash`` of every row: digest, number and keys of its shingles, its fingerprint."""
    common.ship(keyed.sparkSession)
    kinds = [f"{c} {keyed.schema[c].dataType.simpleString()}" for c in ("doc_id", "mark")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = common.raw_texts(batch)
            sets = shingles(texts)
            keys = [band_keys(s) for s in sets]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            columns = [
                pa.array([digest(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys), pa.int64())),
                pa.array([golay.fingerprint(x) for x in texts], pa.int64()),
            ]
            names = ["doc_id", "mark", "fp", "n", "keys", "simhash"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *columns], names)

    return keyed.mapInArrow(run, ", ".join([*kinds, "fp long", "n long", "keys array<long>", "simhash long"]))


def _linked(rows: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of sets whose SimHash fingerprints are equal or linked by operator 4.

    Sets of one fingerprint meet its least one, and the least ones stand for their fingerprints.
    """
    held = common.stage(rows.where("n > 0").select("fp", "simhash").distinct(), "copy-simhashes")
    least = common.stage(held.groupBy("simhash").agg(F.min("fp").alias("least")), "copy-least")
    equal = held.join(least, "simhash").select("least", "fp")
    found = golay.links(least.select(F.col("simhash").alias("fp")))
    one, two = (least.select(F.col("simhash").alias(x), F.col("least").alias(f"of_{x}")) for x in "ab")
    across = found.join(one, "a").join(two, "b").select("of_a", "of_b")
    pairs = equal.union(across).toDF("x", "y").where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose texts have the least similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text_b"):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            place: dict[int, int] = {}
            distinct: list[bytes] = []
            for nodes, column in ((a, "text_a"), (b, "text_b")):
                for node, text in zip(nodes, common.raw_texts(batch, column)):
                    if node not in place:
                        place[node] = len(distinct)
                        distinct.append(text)
            sets = shingles(distinct)
            held = pa.array([similar(sets[place[x]], sets[place[y]]) for x, y in zip(a, b)], pa.bool_())
            yield batch.select(["a", "b"]).filter(held)

    # The least member of a bucket recurs. The pairs of one that does so very often are dealt over
    # ``PARTS`` copies of its text, so that they do not meet in one task.
    often = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > OFTEN)
    often = common.by_size(pairs.sparkSession, common.stage(often.select("a", F.lit(PARTS).alias("parts")), "copy-often"), MOST_OFTEN)
    dealt = pairs.join(often, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int"))
    own = texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")).join(often, "a", "left")
    own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    ends = dealt.select("a", "b", "part").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b")
    ends = ends.join(own.select("a", "part", "text_a"), ["a", "part"])
    return ends.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``fp, text`` of each node of the pairs."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    marked = rows.groupBy("fp").agg(F.min("mark").alias("mark")).join(wanted, "fp")
    marked = common.stage(marked.select("fp", "mark._m1", "mark._m2"), "copy-nodes")
    left = docs.select(*golay.marks(), "text")
    found = left.join(common.by_size(docs.sparkSession, marked, golay.MOST_DROPPED), ["_m1", "_m2"])
    return common.stage(found.select("fp", "text").dropDuplicates(["fp"]), "copy-texts")


def _rooted(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``fp, root`` of each distinct set: its group's least one."""
    nodes = rows.select("fp", "n", "keys").dropDuplicates(["fp"])
    keyed = common.stage(nodes.select("fp", "n", F.explode("keys").alias("key")), "copy-keys")
    buckets = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.count("*").alias("size")).where("size > 1")
    held = common.stage(keyed.join(buckets.select("key", "a"), "key"), "copy-buckets")
    tried = held.where("fp <> a").select("a", F.col("fp").alias("b")).union(_linked(rows))
    tried = common.stage(tried.distinct(), "copy-pairs")
    texts = _texts(docs, rows, tried)
    links = common.stage(_verified(tried, texts), "copy-links")
    roots = components(links)
    left = held.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    left = left.select("key", "fp", "n", F.coalesce("root", "fp").alias("root"))
    left = common.stage(left, "copy-left")
    sizes = left.groupBy("key").agg(
        F.count("*").alias("members"), F.sum("n").alias("shingles"), F.min("root").alias("r"), F.max("root").alias("s")
    )
    mixed = common.stage(left.join(sizes.where("r < s").drop("r", "s"), "key"), "copy-mixed")
    more = common.stage(_pairs(mixed.where(F.col("members") <= SMALL), tried), "copy-more")
    found = _verified(more, texts).union(_in_blocks(mixed.where(F.col("members") > SMALL), texts))
    found = common.stage(found, "copy-links")
    if not found.isEmpty():
        roots = components(links.union(found))
    named = common.stage(roots.withColumnRenamed("node", "fp"), "copy-rooted")
    common.unstage(keyed, held, tried, texts, links, left, mixed, more, found)
    return named


def _pairs(mixed: DataFrame, tried: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of small buckets that may be similar and were not compared yet."""
    one = mixed.select("key", F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("r"))
    two = mixed.select("key", F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("s"))
    up, down = LEAST
    sizes = F.least("n_a", "n_b") * down >= F.greatest("n_a", "n_b") * up
    apart = (F.col("a") < F.col("b")) & (F.col("r") != F.col("s"))
    pairs = one.join(two, "key").where(apart & sizes)
    return pairs.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets, where similar ones are linked."""
    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    # A shingle of one set alone adds to no pair.
    column = np.cumsum(times > 1) - 1
    kept = times[place] > 1
    place, owner = column[place[kept]], owner[kept]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, SLAB):
        part = slice(*np.searchsorted(place, [start, start + SLAB]))
        there = np.zeros((len(sets), SLAB), np.float32)
        there[owner[part], place[part] - start] = 1
        both += there @ there.T
    up, down = LEAST
    near = both * down >= (sizes[:, None] + sizes[None, :] - both) * up
    links, seen = [], np.zeros(len(sets), bool)
    for first in range(len(sets)):
        if seen[first]:
            continue
        seen[first] = True
        waiting = [first]
        while waiting:
            node = waiting.pop()
            new = np.flatnonzero(near[node] & ~seen)
            seen[new] = True
            links.extend((node, int(x)) for x in new)
            waiting.extend(new.tolist())
    return links


def _in_blocks(mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a, b`` that join the groups of the larger buckets."""
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK_ROWS), F.ceil(F.col("shingles") / CHUNK_SHINGLES))
    # Two chunks at least, so that a block is always two different ones.
    chunks = F.greatest(chunks, F.lit(2)).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: x != F.col("own"))
    dealt = mixed.select("key", "fp", chunks.alias("chunks"), own.alias("own"))
    dealt = dealt.withColumn("other", F.explode(others))
    blocks = dealt.select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        fps = block.column("fp").to_numpy()
        held = [x or b"" for x in block.column("text").cast(pa.binary()).to_pylist()]
        ends = np.array(forest(shingles(held)), np.int64).reshape(-1, 2)
        common.give_back()
        return pa.table([pa.array(fps[ends[:, 0]]), pa.array(fps[ends[:, 1]])], names=["a", "b"])

    return blocks.join(texts, "fp").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns: that of the least id, null last."""
    keyed = docs.select("doc_id", "text", F.struct(*golay.marks()).alias("mark"))
    rows = common.stage(_sketched(keyed), "copy-sketches")
    roots = _rooted(docs, rows)
    named = rows.select("fp").distinct().join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return golay.keep_first(docs, rows.select("doc_id", "mark", "fp"), common.stage(named, "copy-roots"))
