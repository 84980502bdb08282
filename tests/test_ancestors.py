"""Merges led to other commits, against a walk in git's own order."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from annalist.operators import ancestors, tags
from annalist.sources import logs

SCHEMA = "repo_name string, hash string, seconds long, parents array<string>"


def walked(table, repo, start):
    """The first non-merge of a walk that always takes the newest commit, as git does."""
    queue, seen = [(-table[repo, start][0], start)], {start}
    best = None
    while queue:
        at, node = heapq.heappop(queue)
        parents = table[repo, node][1]
        if len(parents) < 2:
            # Of equal times the greatest hash counts.
            if best is None or -at > best[0] or (-at == best[0] and node > best[1]):
                best = (-at, node)
            continue
        for p in parents:
            if (repo, p) in table and p not in seen:
                seen.add(p)
                heapq.heappush(queue, (-table[repo, p][0], p))
    return best and best[1]


def history(rng, repo, n, merge_share, tie):
    rows = []
    for i in range(n):
        count = 0 if i == 0 else 2 if i > 3 and rng.random() < merge_share else 1
        parents = sorted({f"c{max(i - 1 - int(rng.expovariate(0.4)), 0)}" for _ in range(count)})
        if count == 2 and rng.random() < 0.05:
            parents.append("lost")
        rows.append((repo, f"c{i}", 10 * (i // tie), parents))
    return rows


@pytest.mark.parametrize("in_range, most_open", [(50_000, 64), (40, 64), (40, 1)])
def test_walks_within_and_across_ranges(spark, monkeypatch, in_range, most_open):
    monkeypatch.setattr(ancestors, "IN_RANGE", in_range)
    monkeypatch.setattr(ancestors, "MOST_OPEN", most_open)
    test_walks_of_random_histories(spark)


def test_few_tables_for_a_long_line(spark, monkeypatch):
    """All walks but those across a border end where their range is; before, each round wrote every merge."""
    rows = [("r", "c0", 0, []), ("r", "c00", 1, [])]
    rows += [("r", f"c{i}", i, [f"c{i - 1}", f"c{max(i - 5, 0)}"] if i % 40 else [f"c{i - 1}"]) for i in range(1, 3001)]
    plain, sizes = ancestors._stored, []
    monkeypatch.setattr(ancestors, "_stored", lambda df: (out := plain(df), sizes.append(out[0].count()))[0])
    monkeypatch.setattr(ancestors, "IN_RANGE", 1000)
    assert ancestors.first_non_merges(spark.createDataFrame(rows, SCHEMA)).count() == 2925
    assert sum(sizes[2:]) < 100


def test_walks_of_random_histories(spark):
    rng = random.Random(2)
    rows = [r for k in range(12) for r in history(rng, f"r{k}", rng.randrange(1, 120), rng.choice([0.3, 0.8, 0.97]), rng.choice([1, 3]))]
    rows += rows[:20] + [("r99", "m", 5, ["gone", "away"])]
    got = {(r[0], r[1]): r[2] for r in ancestors.first_non_merges(spark.createDataFrame(rows, SCHEMA)).collect()}
    table = {(r[0], r[1]): (r[2], r[3]) for r in rows}
    assert set(got) == {k for k, (_, parents) in table.items() if len(parents) > 1}
    for (repo, node), found in got.items():
        assert found == walked(table, repo, node), (repo, node)


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """A mainline of 3000 merges; the plain way would take as many rounds."""
    rows = [("r", "c0", 0, []), ("r", "old", -5, [])]
    rows += [("r", f"c{i}", i, [f"c{i - 1}", "old"]) for i in range(1, 3001)]
    monkeypatch.setattr(ancestors, "MOST_ROUNDS", 14)
    got = ancestors.first_non_merges(spark.createDataFrame(rows, SCHEMA)).groupBy("found").count().collect()
    assert [tuple(r) for r in got] == [("c0", 3000)]


def test_no_merges_and_no_rows(spark):
    frame = spark.createDataFrame([("r", "a", 1, []), ("r", "b", 2, ["a"])], SCHEMA)
    assert ancestors.first_non_merges(frame).count() == 0
    assert ancestors.first_non_merges(frame.limit(0)).count() == 0


def test_lines_of_parents_and_tags_on_merges(spark, tmp_path):
    folder = tmp_path / "parents" / "repo_name=o%2Fa"
    folder.mkdir(parents=True)
    (folder / "p.txt").write_text("m 30 a b\na 20 b\nb 10\n\nbad line\nx notanumber y\n")
    parents = logs.read_parents(spark, str(tmp_path / "parents"))
    assert sorted((r.hash, r.seconds, r.parents) for r in parents.collect()) == [("a", 20, ["b"]), ("b", 10, []), ("m", 30, ["a", "b"])]
    commits = spark.createDataFrame([("o/a", "a", "2020-01-02T00:00:00+00:00"), ("o/a", "b", "2020-01-01T00:00:00+00:00")], "repo_name string, hash string, datetime string")
    refs = spark.createDataFrame([("o/a", "m", "v2"), ("o/a", "b", "v1"), ("o/a", "none", "v0")], "repo_name string, hash string, tag string")
    manifest = spark.createDataFrame([("o/a", "main")], "name string, branch string")
    got = tags.tags(refs, commits, manifest, parents).select("tag", "datetime").collect()
    assert sorted(map(tuple, got)) == [("v1", "2020-01-01T00:00:00+00:00"), ("v2", "2020-01-02T00:00:00+00:00")]
    assert [tuple(r) for r in tags.tag_rejects(refs, commits, parents).collect()] == [("o/a", 1)]
    assert tags.tags(refs, commits, manifest).count() == 1


def test_commits_are_not_shuffled_for_few_tags(spark, tmp_path):
    rows = spark.range(1000).select(F.lit("o/a").alias("repo_name"), F.col("id").cast("string").alias("hash"), F.lit("d").alias("datetime"))
    rows.write.parquet(str(tmp_path / "commits"))
    rows.limit(3).select("repo_name", "hash", F.lit("v").alias("tag")).write.parquet(str(tmp_path / "refs"))
    commits, refs = (spark.read.parquet(str(tmp_path / x)) for x in ("commits", "refs"))
    plan = tags.dated(refs, commits)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan and "SortMergeJoin" not in plan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_commits_are_shuffled_once_as_bytes(spark):
    """Before, each edge and each commit were shuffled to meet, all merges twice more, as text."""
    rows = [("r", f"{k:032x}", k, [f"{max(k - 1, 0):032x}", f"{max(k - 5, 0):032x}"][: 1 + k % 40]) for k in range(200)]
    placed, ranges = ancestors._placed(ancestors._once(spark.createDataFrame(rows, SCHEMA)))
    plan = _plan(ancestors._walked(placed, ranges))
    assert plan.count("+- Exchange") == 1 and "rangepartitioning" not in plan
    assert "SortMergeJoin" not in plan and "Aggregate" not in plan
    assert {(f.name, f.dataType.simpleString()) for f in placed.schema} >= {("id", "binary"), ("ids", "array<binary>")}
    assert placed.selectExpr("max(length(id))").first()[0] == 17


def test_hashes_of_all_shapes_come_back(spark):
    hashes = ["0a", "0A", "abc", "", "f" * 40, "z", "\u00fc", "0a\n", "00"]
    rows = [("r", "old", 0, [])] + [("r", x, 1 + k, []) for k, x in enumerate(hashes)]
    rows += [("r", f"{x}+", 50 + k, ["old", x]) for k, x in enumerate(hashes)] + [("r", x * 2, 80 + k, [x, "old"]) for k, x in enumerate(hashes) if x]
    rows += [(None, "m", 5, ["old", "z"])]
    got = {tuple(r) for r in ancestors.first_non_merges(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("r", f"{x}+", x) for x in hashes} | {("r", x * 2, x) for x in hashes if x} | {(None, "m", None)}


@pytest.mark.parametrize("in_range", [50_000, 20])
def test_parents_newer_than_their_children(spark, monkeypatch, in_range):
    """A wrong clock: a parent that lies in a later range of time than the merge."""
    monkeypatch.setattr(ancestors, "IN_RANGE", in_range)
    rows = [("r", f"c{k}", k, [f"c{k - 1}"]) for k in range(200)]
    rows += [("r", "m", 30, ["c29", "c190"]), ("r", "on", 31, ["m", "c30"]), ("r", "n", 32, ["c31", "late"]), ("r", "late", 150, ["c140", "c149"])]
    got = {r["hash"]: r["found"] for r in ancestors.first_non_merges(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"m": "c190", "on": "c190", "n": "c149", "late": "c149"}


def test_borders_of_one_large_repository(spark, monkeypatch):
    """More ranges than are compared one by one."""
    monkeypatch.setattr(ancestors, "IN_RANGE", 10)
    monkeypatch.setattr(ancestors, "_BORDERS", 4)
    rows = [("r", f"c{k}", k, [f"c{k - 1}", f"c{k - 3}"] if k % 7 and k > 2 else [f"c{k - 1}"][: k]) for k in range(600)]
    frame = spark.createDataFrame(rows + [("s", "x", 5, [])], SCHEMA)
    placed, _ = ancestors._placed(ancestors._once(frame))
    of = placed.groupBy("repo_name", "range").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    lines = sorted((r["range"], r["a"], r["b"], r["n"]) for r in of if r["repo_name"] == "r")
    assert len(lines) > 30 and all(x[2] < y[1] for x, y in zip(lines, lines[1:])) and max(x[3] for x in lines) <= 20
    table = {("r", r[1]): (r[2], r[3]) for r in rows}
    for r in ancestors.first_non_merges(frame).collect():
        assert r["found"] == walked(table, "r", r["hash"]), r


@pytest.mark.parametrize("in_range", [50_000, 2])
def test_rows_of_a_commit_that_differ(spark, monkeypatch, in_range):
    monkeypatch.setattr(ancestors, "IN_RANGE", in_range)
    rows = [("r", "a", 1, []), ("r", "b", 2, ["a"]), ("r", "m", 8, ["a", "gone"]), ("r", "m", 9, ["b", "a"]), ("r", "n", 10, ["m", "a"])]
    # A merge in one row and none in the other.
    rows += [("r", "x", 5, ["a", "b"]), ("r", "x", 3, ["a"]), ("r", "y", 12, ["x", "a"])]
    got = {r["hash"]: r["found"] for r in ancestors.first_non_merges(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"m": "b", "n": "b", "x": "b", "y": "x"}
