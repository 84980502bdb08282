"""Removal of word passages that occur more than once, located by repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one text; each window that also starts anywhere else
is removed with all its words. The steps:

1. Anchors: of the phrases of ``PHRASE`` words in a window, the one with the least hash. Equal
   windows have the same anchor, so only windows whose anchor recurs can recur. One anchor
   serves some dozen windows, which keeps the first count small.
2. The windows of an anchor are hashed together; equal lists are summed before they are taken
   apart, so copies cost little. Windows counted twice or more recur, and each has an example.
3. Examples that follow each other in a text form a confirmed passage, given as text.
4. Texts with recurring anchors are dealt into buckets of bounded size, those with the same
   least anchor together as far as the size allows. A bucket gets the passages that share an anchor with its texts, compiles their anchor phrases into an
   Aho-Corasick automaton, and streams its texts through it. Each hit is extended word by word
   on both sides; where the match with the passage is a window or longer, its words go.

Every part of a passage that is as long as a window recurs, so nothing else is removed; each
recurring window lies in the passage of its example, so nothing is missed. A text without a
recurring anchor is finished after step 1.

Defined cases: null text has no words and comes back empty; texts below a window keep all words; equal rows repeat
each other; null ids are kept as ids; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from annalist.llm import common, hashing

WINDOW = 35
PHRASE = 8
#: Bytes of text in one bucket, about.
BUCKET_BYTES = 4_000_000


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in each run of ``width`` values."""
    place, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(values[left] <= values[right], left, right)
        size += step
    return place


class Texts:
    """The words of some texts with the anchors of their windows, all worked out at once.

    ``window`` has the place of each window's first word in all words, ``owner`` its text,
    ``place`` the place of its anchor.
    """

    def __init__(self, texts: list[bytes], window: int):
        self.split = [t.split() for t in texts]
        sizes = np.fromiter(map(len, self.split), np.int64, len(texts))
        self.begin = np.cumsum(sizes) - sizes
        self.words = [w for words in self.split for w in words]
        counts = np.maximum(sizes - window + 1, 0)
        self.owner = np.repeat(np.arange(len(texts)), counts)
        within = np.arange(len(self.owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.window = self.begin[self.owner] + within
        self.place = self.window
        if len(self.window):
            self.hashes = hashing.word_hashes(self.words)
            self.phrases = hashing.gram_hashes(self.hashes, PHRASE, 1)
            self.place = least_places(self.phrases, window - PHRASE + 1)[self.window]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last of the windows that share a text and an anchor place."""
        if not len(self.window):
            return self.window, self.window
        cuts = np.flatnonzero((np.diff(self.place) != 0) | (np.diff(self.owner) != 0)) + 1
        return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(self.place)]])

    def anchors(self, at: np.ndarray) -> np.ndarray:
        """The anchor hash of windows by number."""
        return self.phrases[self.place[at]] if len(at) else np.zeros(0, np.uint64)


def listed(owner: np.ndarray, values: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which values stand in the list of their own text."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    tag = lambda row, value: value ^ hashing.mix((row + 1).astype(np.uint64))
    return np.isin(tag(owner, values), tag(np.repeat(np.arange(len(lists)), sizes), flat))


def _digest(words: list[bytes], keep: np.ndarray | None, data: bytes) -> tuple:
    """n_words, n_removed and the hash of the kept words."""
    kept = words if keep is None else [w for w, k in zip(words, keep.tolist()) if k]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _cut(words: list[bytes], keep: np.ndarray | None, data: bytes) -> tuple:
    """The text without the removed words and the white space after each; others stay as they are."""
    if keep is None or keep.all():
        return (data.decode(errors="replace"),)
    flags = np.frombuffer(data, np.uint8)
    space = (flags == 32) | ((flags >= 9) & (flags <= 13))
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    lead = int(starts[0])
    ends = np.append(starts[1:], len(data))
    stay = np.concatenate([np.ones(lead, bool), np.repeat(keep, ends - starts)])
    return (flags[stay].tobytes().decode(errors="replace"),)


OUTPUTS: dict[str, tuple[Callable, str]] = {
    "digest": (_digest, "n_words long, n_removed long, kept_sha256 string"),
    "text": (_cut, "text string"),
}


def _table(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def anchor_lists(anchors: DataFrame) -> DataFrame:
    """``key, anchors, least, size`` of each text with anchors that recur; ``size`` is that of all its copies."""
    recurring = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    lists = anchors.select("anchor", "key", "size").join(recurring, "anchor").groupBy("key")
    # Each copy of a row has every anchor of its text once.
    copies = F.ceil(F.sum("size") / F.size(F.collect_set("anchor")))
    return lists.agg(F.collect_set("anchor").alias("anchors"), F.min("anchor").alias("least"), copies.alias("size"))


def bucket_parts(lists: DataFrame) -> DataFrame:
    """``least, parts``: into how many buckets the texts with the same least anchor go.

    They mostly share passages, so they go to one bucket, or to as many as their size asks for.
    """
    return lists.groupBy("least").agg(F.ceil(F.sum("size") * 4 / BUCKET_BYTES).alias("parts"))


def remove_repeats(docs: DataFrame, output: str = "digest", window: int = WINDOW, text: str = "text") -> DataFrame:
    """All columns of the rows but the text, and the columns of the output: digests or new text."""
    spark = docs.sparkSession
    common.ship(spark)
    finish, added = OUTPUTS[output]
    others = [c for c in docs.columns if c != text]
    named = docs.select(F.struct(*[common.named(c) for c in others]).alias("row"), common.named(text).alias("text"))
    named = named.withColumn("key", F.xxhash64(F.to_json("row"), "text"))

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = common.raw_texts(batch)
            bytes_ = np.fromiter(map(len, texts), np.int64, len(texts))
            t = Texts(texts, window)
            first = t.runs()[0]
            owner, found = t.owner[first], t.anchors(first)
            order = np.lexsort((found, owner))
            owner, found = owner[order], found[order]
            new = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (found[1:] != found[:-1]))[: len(found)])
            n = np.minimum(np.diff(np.append(new, len(found))), 2)
            keys = batch.column("key").to_numpy()[owner[new]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[new].view(np.int64)), pa.array(keys), pa.array(n), pa.array(bytes_[owner[new]])],
                ["anchor", "key", "n", "size"],
            )

    anchors = common.stage(named.select("key", "text").mapInArrow(find_anchors, "anchor long, key long, n long, size long"), "phrase-anchors")
    lists_stage = lists = common.stage(anchor_lists(anchors), "phrase-lists")
    lists = lists.drop("size").join(bucket_parts(lists), "least")

    out = T.StructType([named.schema["row"], T.StructField("key", T.LongType()), T.StructField("text", T.StringType())])
    out = T.StructType([*out.fields, T.StructField("anchors", T.ArrayType(T.LongType())), T.StructField("least", T.LongType()), T.StructField("parts", T.LongType()), *T._parse_datatype_string(added.replace("text ", "new_text ")).fields])

    def finish_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for batch in common.slices(batches):
            lists = batch.column("anchors")
            open_rows = lists.is_valid()
            texts = common.raw_texts(batch)
            none = (None,) * (len(schema) - 6)
            done = [none if o else finish(d.split(), None, d) for o, d in zip(open_rows.to_pylist(), texts)]
            left = pa.array([d if o else None for o, d in zip(open_rows.to_pylist(), texts)], pa.binary()).cast(pa.string())
            held = [batch.column(c) for c in ("anchors", "least", "parts")]
            yield _table([batch.column("row"), batch.column("key"), left, *held, *map(list, zip(*done))], schema)

    joined = named.join(lists, "key", "left").select("row", "key", "text", "anchors", "least", "parts")
    held = joined.mapInArrow(finish_clean, out).withColumn("place", F.monotonically_increasing_id())
    held = common.stage(held, "phrase-texts")
    common.unstage(anchors, lists_stage)
    clean = held.where("anchors IS NULL")
    texts = held.where("anchors IS NOT NULL").select("row", "key", "text", "anchors", "least", "parts", "place")

    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    spread = F.xxhash64("least", F.pmod(F.xxhash64("place"), F.col("parts")))
    dealt = texts.withColumn("bucket", F.pmod(spread, F.lit(buckets)).cast("int"))

    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            t = Texts(common.raw_texts(batch), window)
            first, end = t.runs()
            keep = listed(t.owner[first], t.anchors(first), batch.column("anchors"))
            first, end = first[keep], end[keep]
            if not len(first):
                continue
            hashes = hashing.gram_hashes(t.hashes, window, 2).view(np.int64)
            sizes = end - first
            at = np.repeat(first, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(t.anchors(first).view(np.int64)),
                    pa.ListArray.from_arrays(ends, pa.array(hashes[t.window[at]])),
                    pa.array(batch.column("key").to_numpy()[t.owner[first]]),
                    pa.array(batch.column("bucket").to_numpy()[t.owner[first]]),
                ],
                ["anchor", "windows", "key", "bucket"],
            )

    found = dealt.select("key", "text", "anchors", "bucket").mapInArrow(
        list_windows, "anchor long, windows array<long>, key long, bucket int"
    )
    # Texts of a bucket share many lists of windows; each stands here once per bucket.
    found = found.groupBy("bucket", "anchor", "windows").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    found = common.stage(found, "phrase-windows")
    # The example of a window is in the text of the least key, so that the windows of a passage
    # that several texts share have their examples side by side.
    each = found.select("anchor", "n", "key", F.explode("windows").alias("hash"))
    counted = each.groupBy("anchor", "hash").agg(F.sum("n").alias("n"), F.min("key").alias("example"))
    counted = common.stage(counted.where("n > 1").drop("n"), "phrase-examples")
    examples = counted.groupBy(F.col("example").alias("key")).agg(F.collect_set("hash").alias("windows"))

    def cut_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            t = Texts(common.raw_texts(batch), window)
            if not len(t.window):
                continue
            hashes, keys = hashing.gram_hashes(t.hashes, window, 2), batch.column("key").to_numpy()
            at = np.flatnonzero(listed(t.owner, hashes[t.window], batch.column("windows")))
            # One example of a window is enough, also where a text repeats it.
            order = np.lexsort((at, hashes[t.window[at]], t.owner[at]))
            ordered = hashes[t.window[at[order]]]
            again = (np.diff(t.owner[at[order]]) == 0) & (ordered[1:] == ordered[:-1])
            at = np.sort(at[order[np.flatnonzero(np.append(True, ~again)[: len(at)])]])
            rows: list[list] = [[], [], [], [], [], []]
            for run in np.split(at, np.flatnonzero((np.diff(at) > 1) | (np.diff(t.owner[at]) != 0)) + 1):
                if not len(run):
                    continue
                begin, end = int(t.window[run[0]]), int(t.window[run[-1]]) + window
                passage = b" ".join(t.words[begin:end])
                cuts = np.flatnonzero(np.diff(t.place[run])) + 1
                first, last = t.window[run[np.append(0, cuts)]], t.window[run[np.append(cuts, len(run)) - 1]]
                rows[0].append(hashlib.md5(passage).digest())
                rows[1].append(keys[t.owner[run[0]]])
                rows[2].append(passage)
                rows[3].append(t.anchors(run[np.append(0, cuts)]).view(np.int64))
                rows[4].append(last - begin)
                rows[5].append(first + window - last)
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kinds)], ["id", "example", "passage", "anchors", "cores", "sizes"]
            )

    sources = texts.select("key", "text").join(examples, "key")
    passages = sources.mapInArrow(
        cut_passages, "id binary, example long, passage binary, anchors array<long>, cores array<int>, sizes array<int>"
    )
    passages = common.stage(passages.dropDuplicates(["id"]), "phrase-passages")

    # A bucket gets the passages that hold the example of a window of its texts.
    wanted = found.select("bucket", "anchor", F.explode("windows").alias("hash")).join(counted, ["anchor", "hash"])
    wanted = wanted.select("bucket", "anchor", "example").distinct()
    named_passages = passages.select("id", "example", F.explode("anchors").alias("anchor"))
    wanted = wanted.join(named_passages, ["example", "anchor"]).select("bucket", "id").distinct()
    sent = wanted.join(passages, "id").select(F.col("bucket").alias("shard"), "passage", "cores", "sizes")

    final = T.StructType([named.schema["row"], *T._parse_datatype_string(added.replace("text ", "new_text ")).fields])

    def locate(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = [x or b"" for x in left.column("text").cast(pa.binary()).to_pylist()]
        split = [t.split() for t in texts]
        passages = [p.split() for p in right.column("passage").to_pylist()]
        cores, sizes = (right.column(c).to_pylist() for c in ("cores", "sizes"))
        keeps = covered(split, passages, cores, sizes, window)
        done = [finish(w, k, d) for w, k, d in zip(split, keeps, texts)]
        schema = to_arrow_schema(final)
        row = left.column("row").combine_chunks()
        row = row if isinstance(row, pa.Array) else pa.concat_arrays(row.chunks)
        columns = list(zip(*done)) or [()] * (len(schema) - 1)
        del split, passages, keeps, texts
        common.give_back()
        return pa.Table.from_batches([_table([row, *map(list, columns)], schema)])

    located = dealt.select("bucket", "row", "text").groupBy("bucket").cogroup(sent.groupBy("shard")).applyInArrow(locate, final)
    result = clean.select(located.columns).unionByName(located)
    named_out = [F.col("row")[c].alias(c) for c in others]
    return result.select(*named_out, *[F.col(c).alias("text" if c == "new_text" else c) for c in final.names[1:]])


def covered(
    texts: list[list[bytes]], passages: list[list[bytes]], cores: list[list[int]], sizes: list[list[int]], window: int
) -> list[np.ndarray]:
    """For each text which words stay: those in no match with a passage of a window or more.

    A core is what all windows of a passage with the same anchor share: every place of such a
    window holds it, so the automaton looks for cores.
    """
    import ahocorasick

    numbers: dict[bytes, int] = {}
    gap = window

    def joined(lists: list[list[bytes]], blank: int) -> tuple[np.ndarray, list[int]]:
        out, begins, at = [np.full(gap, blank)], [], gap
        for words in lists:
            begins.append(at)
            out.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
            out.append(np.full(gap, blank))
            at += len(words) + gap
        return np.concatenate(out), begins

    known, known_begins = joined(passages, -1)
    mine, begins = joined(texts, -2)
    automaton = ahocorasick.Automaton()
    places: list[list[int]] = []
    lengths: list[int] = []
    for words, begin, own, own_sizes in zip(passages, known_begins, cores, sizes):
        for place, size in zip(own, own_sizes):
            core = (b" " + b" ".join(words[place : place + size]) + b" ").decode("latin-1")
            number = automaton.get(core, None)
            if number is None:
                number = len(places)
                automaton.add_word(core, number)
                places.append([])
                lengths.append(size)
            places[number].append(begin + place)
    cover = np.zeros(len(mine) + 1, np.int64)
    if places:
        automaton.make_automaton()
        length = np.array(lengths)
        count = np.array([len(p) for p in places])
        flat = np.array([x for p in places for x in p])
        flat_begin = np.cumsum(count) - count
        for words, begin in zip(texts, begins):
            if len(words) < window:
                continue
            hay = (b" " + b" ".join(words) + b" ").decode("latin-1")
            hits = list(automaton.iter(hay))
            if not hits:
                continue
            ends, found = np.array(hits).T
            # A core ends with the blank before the next word.
            after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            at = begin + np.searchsorted(after, ends) + 1 - length[found]
            for part in range(0, len(at), 4096):
                chosen = found[part : part + 4096]
                n = count[chosen]
                d = np.repeat(at[part : part + 4096], n)
                within = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
                p = flat[np.repeat(flat_begin[chosen], n) + within]
                extend(cover, mine, known, d, p, np.repeat(length[chosen], n), window)
    stays = np.cumsum(cover)[:-1] <= 0
    return [stays[b : b + len(w)] for b, w in zip(begins, texts)]


def extend(
    cover: np.ndarray, mine: np.ndarray, known: np.ndarray, d: np.ndarray, p: np.ndarray, length: np.ndarray, window: int
) -> None:
    """Mark where texts match passages around cores at ``d`` and ``p`` for a window or more."""
    left, right = d, d + length
    alive = np.arange(len(d))
    for step in range(1, window):
        alive = alive[mine[d[alive] - step] == known[p[alive] - step]]
        if not len(alive):
            break
        left = left.copy() if step == 1 else left
        left[alive] = d[alive] - step
    alive = np.arange(len(d))
    for step in range(window):
        alive = alive[mine[d[alive] + length[alive] + step] == known[p[alive] + length[alive] + step]]
        if not len(alive):
            break
        right[alive] = d[alive] + length[alive] + step + 1
    long = right - left >= window
    np.add.at(cover, left[long], 1)
    np.add.at(cover, right[long], -1)
