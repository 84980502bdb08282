"""Streaks read from merged bits against days counted one by one."""

import datetime
import random

from annalist.operators import streak_state
from annalist.operators.streak import longest_streak

START = datetime.date(1970, 1, 1)


def longest(days):
    days, best, i = sorted(set(days)), (0, 0, 0), 0
    while i < len(days):
        j = i
        while j + 1 < len(days) and days[j + 1] == days[j] + 1:
            j += 1
        if j - i + 1 > best[0]:
            best = (j - i + 1, days[i], days[j])
        i = j + 1
    return best[0], *(str(START + datetime.timedelta(d)) for d in best[1:])


def rows_of(days):
    return [f"{START + datetime.timedelta(d)}T12:00:00+00:00" for d in days]


def random_days(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.randrange(20_000) for _ in range(rng.randrange(1, 40))]
    if kind == 1:
        first = rng.randrange(15_000)
        return [first + k for k in range(rng.choice([1, 63, 64, 65, 128, 300]))]
    first = 64 * rng.randrange(200)
    return [first + k for k in range(400) if rng.random() < rng.choice([0.9, 0.98])]


def test_random_groups(spark):
    rng = random.Random(6)
    groups = {k: random_days(rng) for k in range(150)}
    rows = [(g, d) for g, days in groups.items() for d in rows_of(days + days[:3])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + [(0, "no time"), (0, None), (999, "no time")], "g long, datetime string")
    got = streak_state.longest_of_state(streak_state.streak_state(df, ["g"]), ["g"]).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {g: longest(days) for g, days in groups.items()}
    halves = [df.filter(f"hash(datetime) % 2 {op} 0") for op in ("=", "<>")]
    merged = streak_state.merge_states([streak_state.streak_state(h, ["g"]) for h in halves], ["g"])
    assert sorted(map(tuple, streak_state.longest_of_state(merged, ["g"]).collect())) == sorted(map(tuple, got))
    once = longest_streak(df.filter("g <> 999"), ["g"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, got))


def test_rollup_tells_null_from_left_out(spark):
    days = {("a", 1): [1, 2, 3, 10], ("a", 2): [4, 5], (None, 1): [6, 7, 8]}
    rows = [(n, y, d) for (n, y), ds in days.items() for d in rows_of(ds)]
    df = spark.createDataFrame(rows, "name string, y int, datetime string")
    got = {tuple(r)[:3]: r[3] for r in streak_state.streak_rollup(df, [("name",), ("y",), ()]).collect()}
    assert got == {(1, "a", None): 5, (1, None, None): 3, (2, None, 1): 3, (2, None, 2): 2, (3, None, None): 8}


def test_state_is_small_and_sums_in_part(spark):
    df = spark.createDataFrame([("g", d) for d in rows_of(range(640)) * 3], "g string, datetime string")
    state = streak_state.streak_state(df, ["g"])
    assert state.count() == 10
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "partial_bit_or" in plan
    assert streak_state.longest_of_state(streak_state.streak_state(df.limit(0), ["g"]), ["g"]).count() == 0
