"""Points in intervals against all pairs; prefixes in a table against all prefixes."""

import random

import pytest

from annalist.operators import intervals
from annalist.sources import manifest as manifests


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_join_equals_all_pairs(spark, width):
    rng = random.Random(width)
    points = [(i, rng.choice([None, *range(-50, 50)]) if rng.random() < 0.3 else rng.randrange(-10**6, 10**6)) for i in range(400)]
    ranges = []
    for k in range(150):
        start = rng.randrange(-10**6, 10**6)
        ranges.append((k, start, start + rng.choice([-3, 0, 1, 2, 50, 5_000, 700_000, 10**13])))
    ranges += [(900, None, 5), (901, 5, None), (902, -(10**12), 10**12), (902, -(10**12), 10**12)]
    p = spark.createDataFrame(points, "i long, at long")
    r = spark.createDataFrame(ranges, "k long, start long, stop long")
    want = [(i, at, *x) for i, at in points for x in ranges if None not in (at, *x) and x[1] <= at < x[2]]
    got = intervals.interval_join(p, r, "at", "start", "stop", width)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    few = r.filter("k = 0 AND stop > start")
    left = intervals.interval_join(p, few, "at", "start", "stop", width, how="left").collect()
    inside = {i for i, at in points for x in ranges[:1] if at is not None and x[1] <= at < x[2]}
    assert len(left) == len(points) and {x["i"] for x in left if x["k"] is not None} == inside
    assert intervals.interval_join(p, r.limit(0), "at", "start", "stop", width).count() == 0
    assert intervals.interval_join(p, r.limit(0), "at", "start", "stop", width, how="left").count() == len(points)


def test_prefixes_in_a_table(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abß/", k=n))
    names = [word(rng.randrange(0, 9)) for _ in range(300)] + [None]
    for prefixes in ([word(rng.randrange(1, 6)) for _ in range(12)], [""], [], [None], ["a", None, "a"]):
        table = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
        frame = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, k long")
        got = sorted(r["k"] for r in manifests.exclude_prefix_table(frame, table).collect())
        given = [p for p in prefixes if p is not None]
        want = [k for k, n in enumerate(names) if n is None or not any(n.startswith(p) for p in given)]
        assert got == want, prefixes


def test_sums_equal_those_of_the_pairs(spark):
    rng = random.Random(5)
    points = [(rng.choice([None, *range(40)]), rng.choice([None, *range(9)])) for _ in range(300)]
    ranges = [(k % 20, rng.randrange(45), rng.choice([None, *range(60)])) for k in range(60)]
    want = {}
    for k, (of, start, stop) in enumerate(ranges):
        inside = [v for at, v in points if None not in (at, stop) and start <= at < stop]
        if inside:
            known = [v for v in inside if v is not None]
            want[k] = (of, start, stop, len(inside), sum(known) if known else None)
    p = spark.createDataFrame(points, "at long, v long")
    r = spark.createDataFrame(ranges, "of long, start long, stop long")
    got = intervals.interval_sums(p, r, "at", "start", "stop", {"total": "v"}, "n", width=7)
    key = lambda row: tuple((x is not None, x) for x in row)
    assert got.columns == ["of", "start", "stop", "n", "total"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.values(), key=key)


def test_rows_of_one_place_meet_an_interval_once(spark):
    p = spark.range(40_000).selectExpr("id % 2 AS at", "id AS v")
    r = spark.range(40_000).selectExpr("id AS k", "0L AS start", "2L AS stop")
    # 1.6 billion pairs if they were made.
    got = intervals.interval_sums(p, r, "at", "start", "stop", {"total": "v"}, "n")
    assert got.distinct().count() == 40_000
    assert got.select("n", "total").distinct().collect() == [(40_000, 40_000 * 39_999 // 2)]
