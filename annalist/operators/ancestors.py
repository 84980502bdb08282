"""The first non-merge commit that a commit leads to, for commits that are merges themselves.

``git log --no-merges -n 1 <merge>`` walks from a merge to its parents, newest first, and stops at
the first commit that is no merge. Where no parent is newer than its child this is the newest
non-merge commit in reach through merges alone. A mainline of merges makes that walk long, so it
is not followed step by step. First the commits of a repository lie in ranges of their time, where a
task walks from merge to merge as far as its range goes; what is left are walks that cross the
border of a range. Only the parents behind a border are looked up among all commits, and hashes travel
as bytes, so that all but a few commits are shuffled once. Of the merges behind a border each then
holds those at a distance of 1, 2, 4, ... crossings and the best commit found on the way, and each
round looks both up in the table of these merges. A merge lets go of those that are older than what
it has found, since nothing behind them can be better.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.sources import shared, workers

#: Rounds double the distance; a history longer than this many doublings is damaged.
MOST_ROUNDS = 48
#: Commits in a range, about, and what a merge holds at most from beyond it before it is left to the rounds.
IN_RANGE, MOST_OPEN = 50_000, 64
#: Commits whose times are looked at to find the borders of a range, about.
_LOOKED_AT = 100
#: Borders that are compared one by one; more are first told apart by every such one.
_BORDERS = 32

_ID = ("repo_name", "hash")
_END = "struct<at:bigint,hash:string>"


def _stored(df: DataFrame) -> "tuple[DataFrame, str]":
    """Written to the shared folder and read again, so that no round depends on the one before."""
    path = shared.folder(df.sparkSession, "merges")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def first_non_merges(parents: DataFrame) -> DataFrame:
    """``repo_name, hash, found`` of every merge; ``found`` is NULL where none is in reach.

    ``parents`` has ``repo_name, hash, seconds, parents``, one row per commit, as
    ``logs.read_parents`` gives it.

    A parent that the table lacks, as in a shallow clone, is no commit to be found. Of commits of
    the same time the one with the greatest hash is found. Rows that repeat a commit count once.
    The rounds grow with the logarithm of the longest chain of merges; what a merge holds is as
    wide as the history is at that distance.
    """
    known = _once(parents)
    placed, ranges = _placed(known)
    state, whole = _stored(_walked(placed, ranges))
    # Parents in no range of their child: most are older than all of it, so that they cannot be better
    # than what is found in it. Where a clock was wrong they are not; such ones are shown to the range.
    outside, _ = _stored(state.filter(F.size("outside") > 0).select("repo_name", "range", "least", F.explode("outside").alias("hash")).distinct())
    wanted = outside.select(*_ID).distinct()
    times, _ = _stored(known.select(*_ID, "place", "at", "merge").join(wanted, list(_ID), "left_semi"))
    late = outside.join(times, list(_ID)).filter(F.col("place") >= F.col("least"))
    if not late.isEmpty():
        shown = late.select("repo_name", "range", _packed(F.col("hash")).alias("id"), "at", "merge", F.lit(None).cast("array<binary>").alias("ids"), F.lit(True).alias("shown"))
        state, _ = _stored(_walked(placed.unionByName(shown), ranges))
        shared.remove(known.sparkSession, whole)
    state = state.select("repo_name", "of", "best", "open")
    found = lambda rows: rows.select("repo_name", F.col("of").alias("hash"), F.col("best.hash").alias("found"))
    open_ = F.size("open") > 0
    if state.filter(open_).isEmpty():
        return found(state)
    crossing, _ = _stored(_pruned(_timed(state.filter(open_), times)))
    state = state.filter(~open_).unionByName(crossing)
    steps = crossing.filter(open_).select("repo_name", "of", "best", F.explode("open.hash").alias("via"))
    # Stored, so that its size is known and the state is not shuffled to meet it.
    asked, _ = _stored(steps.select("repo_name", F.col("via").alias("of")).distinct())
    if asked.isEmpty():
        return found(state)
    behind = _doubled(state.join(asked, ["repo_name", "of"], "left_semi"))
    reached = behind.select("repo_name", F.col("of").alias("via"), F.col("best").alias("further"))
    led = steps.join(reached, ["repo_name", "via"]).groupBy("repo_name", F.col("of").alias("hash"))
    led = led.agg(F.greatest(F.max("best"), F.max("further"))["hash"].alias("found"))
    return found(state.filter(~open_)).unionByName(led)


def _once(parents: DataFrame) -> DataFrame:
    """``repo_name, hash, place, at, merge, parents``, each commit once or in rows that are the same.

    A commit whose rows differ is a merge of all parents of those that are merges, of their latest
    time, and beside it a commit of the latest time of the others. Its ``place`` in time is the later.
    """
    # What has no time is older than all that has one.
    at, merge = F.coalesce("seconds", F.lit(-(1 << 63))), F.size("parents") > 1
    rows = parents.filter("hash IS NOT NULL AND parents IS NOT NULL")
    known = rows.select(*_ID, at.alias("place"), at.alias("at"), merge.alias("merge"), "parents")
    row = F.xxhash64("at", "parents")
    sums = known.groupBy(F.xxhash64(*_ID).alias("commit")).agg(F.min(row).alias("a"), F.max(row).alias("b"))
    if sums.filter("a <> b").isEmpty():
        return known
    kinds = known.groupBy(*_ID, "merge").agg(F.max("at").alias("at"), F.collect_set("parents").alias("all"))
    kind = F.struct("at", "merge", F.flatten("all").alias("parents"))
    both = kinds.groupBy(*_ID).agg(F.max("at").alias("place"), F.collect_list(kind).alias("kinds"))
    return both.select(*_ID, "place", F.inline("kinds")).select(*known.columns)


def _packed(c: Column) -> Column:
    """A hash as bytes, two digits in one, with what tells it from other text in front."""
    digits = c.rlike(r"^(?:[0-9a-f]{2})+\z")
    return F.when(digits, F.concat(F.lit(b"\x01"), F.unhex(c))).otherwise(F.concat(F.lit(b"\x00"), c.cast("binary")))


def _text(packed: bytes) -> str:
    return packed[1:].hex() if packed[0] else packed[1:].decode()


def _placed(known: DataFrame) -> "tuple[DataFrame, int]":
    """``repo_name, range, id, at, merge, ids, shown``: commits with the range of their repository's time.

    With it the number of ranges, about. Commits of one time are in one range, so that a parent
    outside it is older than all of it, unless it is newer than its child.
    """
    spark = known.sparkSession
    total = known.count()
    borders: dict[str, list[int]] = {}
    if total > IN_RANGE:
        # The times of some commits tell where to cut; each commit is in a range wherever that is.
        share = min(1.0, max(_LOOKED_AT / IN_RANGE, 10 * _LOOKED_AT / total))
        seen: dict[str, list[int]] = {}
        for repo, at in known.select("repo_name", "place").sample(share, 1).collect():
            seen.setdefault(repo, []).append(at)
        step = max(1, round(IN_RANGE * share))
        for repo, at in seen.items():
            at.sort()
            borders[repo] = sorted({at[i] for i in range(step, len(at) - step // 2, step)} - {at[0]})
    rows = [(r, b[_BORDERS::_BORDERS], [b[i : i + _BORDERS] for i in range(0, len(b), _BORDERS)]) for r, b in borders.items() if r is not None and b]
    table = spark.createDataFrame(rows, "repo_name string, coarse array<bigint>, fine array<array<bigint>>")
    before = lambda c: F.size(F.filter(c, lambda x: x <= F.col("place")))
    group = before(F.col("coarse"))
    number = F.coalesce(group * _BORDERS + before(F.get("fine", group)), F.lit(0))
    ids = F.when(F.col("merge"), F.transform("parents", _packed))
    found = known.join(F.broadcast(table), "repo_name", "left")
    found = found.select("repo_name", number.alias("range"), _packed(F.col("hash")).alias("id"), "at", "merge", ids.alias("ids"), F.lit(False).alias("shown"))
    return found, -(-total // IN_RANGE) or 1


def _walked(placed: DataFrame, ranges: int) -> DataFrame:
    """``repo_name, range, least, of, best, open, outside`` of each merge, each walk as far on as it stays in its range.

    ``open`` are merges that the walk waits for, and parents outside the range, which have no time.
    ``outside`` are such parents of the merge itself, ``least`` is the first time of the range.
    """
    workers.ship(placed.sparkSession)
    most = MOST_OPEN
    end = pa.struct([("at", pa.int64()), ("hash", pa.string())])
    kind = pa.schema([("repo_name", pa.string()), ("range", pa.int32()), ("least", pa.int64()), ("of", pa.string()), ("best", end), ("open", pa.list_(end)), ("outside", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows = [b for b in batches if b.num_rows]
        if not held_rows:
            return
        table = pa.Table.from_batches(held_rows).combine_chunks()
        # By time, so that parents come before their children.
        table = table.sort_by([(c, "ascending") for c in ("repo_name", "range", "at")])
        columns = [table.column(c).to_pylist() for c in ("repo_name", "range", "id", "at", "merge", "ids", "shown")]
        ended = lambda m: m and {"at": m[0], "hash": m[1]}
        for (repo, number), rows in groupby(zip(*columns), key=lambda r: r[:2]):
            least, done = walk(((_text(r[2]), r[3], r[4], r[5], r[6]) for r in rows), most, repo is not None)
            for of in range(0, len(done), 10_000):
                some = done[of : of + 10_000]
                arrays = [[repo] * len(some), [number] * len(some), [least] * len(some)]
                arrays += [[d[0] for d in some], [ended(d[1]) for d in some], [[ended(m) for m in d[2]] for d in some], [d[3] for d in some]]
                yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, kind)], schema=kind)

    schema = f"repo_name string, range int, least bigint, of string, best {_END}, open array<{_END}>, outside array<string>"
    return placed.repartition(ranges, "repo_name", "range").mapInArrow(run, schema)


def walk(rows: Iterable[tuple], most: int, named: bool = True) -> "tuple[int, list[tuple]]":
    """The first time of a range, and ``of, best, open, outside`` of its merges.

    ``rows`` are ``hash, at, merge, ids, shown``, by time; ``shown`` are those of other ranges. Without
    a name of the repository no parent is found.
    """
    least, plain, merges, own = None, {}, {}, {}
    for of, at, merge, ids, shown in rows:
        (merges if merge else plain)[of] = at
        if not shown:
            least = at if least is None else least
            if merge:
                own[of] = ids
    done: dict[str, tuple] = {}
    ended = []
    for of, ids in own.items():
        best, held, direct, outside = None, set(), set(), []
        for p in {_text(x) for x in ids if x is not None} if named else ():
            if p in plain:
                best = max(best, (plain[p], p)) if best else (plain[p], p)
            if p in merges:
                direct.add((merges[p], p))
            elif p not in plain:
                outside.append(p)
                direct.add((None, p))
        for m in direct:
            if m[1] in done:
                further, beyond = done[m[1]]
                best = max(best, further) if best and further else best or further
                held |= beyond
            else:
                held.add(m)
        # What has no time is older than the range.
        held = {m for m in held if best is None or (m[0] is not None and m[0] >= best[0])}
        done[of] = best, held if len(held) <= most else direct
        ended.append((of, *done[of], outside))
    return least, ended


def _timed(waiting: DataFrame, times: DataFrame) -> DataFrame:
    """The state with the parents outside the ranges looked up."""
    steps = waiting.select("repo_name", "of", "best", F.explode("open").alias("m")).withColumn("hash", F.col("m.hash"))
    steps = steps.join(times, list(_ID), "left").withColumn("end", F.struct(F.coalesce("m.at", "at").alias("at"), "hash"))
    inside = F.col("m.at").isNotNull()
    return steps.groupBy("repo_name", "of").agg(
        F.greatest(F.max("best"), F.max(F.when(~inside & ~F.col("merge"), F.col("end")))).alias("best"),
        F.collect_set(F.when(inside | F.col("merge"), F.col("end"))).alias("open"),
    )


def _doubled(state: DataFrame) -> DataFrame:
    """The state when no walk is left; all merges that one of its walks waits for are in it."""
    spark = state.sparkSession
    state, path = _stored(state)
    for _ in range(MOST_ROUNDS):
        waiting = state.filter(F.size("open") > 0)
        if waiting.isEmpty():
            return state
        steps = waiting.select("repo_name", "of", "best", F.explode("open").alias("via"))
        steps = steps.withColumn("via", F.col("via.hash"))
        reached = state.select(
            "repo_name", F.col("of").alias("via"), F.col("best").alias("further"), F.col("open").alias("beyond")
        )
        moved = (
            steps.join(reached, ["repo_name", "via"])
            .groupBy("repo_name", "of")
            .agg(
                F.greatest(F.max("best"), F.max("further")).alias("best"),
                F.array_distinct(F.flatten(F.collect_set("beyond"))).alias("open"),
            )
        )
        done = state.filter(F.size("open") == 0)
        before = path
        state, path = _stored(done.unionByName(_pruned(moved)))
        shared.remove(spark, before)
    raise ValueError("the parents of these commits lead back to them")


def _pruned(state: DataFrame) -> DataFrame:
    """Without the merges that are older than the best commit found."""
    newer = F.filter("open", lambda m: F.col("best").isNull() | (m["at"] >= F.col("best.at")))
    return state.withColumn("open", newer)
