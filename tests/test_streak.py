from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from annalist.functions import sqlfn
from annalist.operators.streak import longest_streak

CASES = [
    ([], (0, 0, 0)),
    ([90], (1, 90, 90)),
    ([31, 30], (2, 30, 31)),
    ([11, 13, 15, 17], (1, 11, 11)),
    ([40, 41, 50, 51, 60, 61, 62, 63], (4, 60, 63)),
    ([5, 6, 7, 30, 31, 32, 99], (3, 5, 7)),
    ([7, 7, 7, 5, 6], (3, 5, 7)),
]


def day_text(day):
    return (date(1970, 1, 1) + timedelta(days=day)).isoformat()


def moment(day, second=0):
    return f"{day_text(day)}T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z"


def brute_force(days):
    best = (0, 0, 0)
    for start in sorted(set(days)):
        end = start
        while end + 1 in days:
            end += 1
        if end - start + 1 > best[0]:
            best = (end - start + 1, start, end)
    return best


def grouped(spark, groups):
    rows = [(g, moment(d, 37 * i % 86400)) for g, days in groups.items() for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "repo_name string, datetime string")
    return {r[0]: tuple(r)[1:] for r in longest_streak(df, ["repo_name"]).collect()}


@pytest.mark.parametrize("days, expected", CASES)
def test_sql_form(spark, days, expected):
    sqlfn.register(spark)
    df = spark.createDataFrame([(days,)], "days array<bigint>")
    assert tuple(df.selectExpr("streak(days) AS s").first().s) == expected


@pytest.mark.parametrize("days, expected", CASES)
def test_window_form(spark, days, expected):
    rows = [(moment(d, 40_000),) for d in days]
    df = spark.createDataFrame(rows, "datetime string")
    n, start, end = expected
    assert tuple(longest_streak(df).first()) == (n, day_text(start), day_text(end))


def test_four_known_rows(spark):
    texts = [
        "2021-10-12T14:20:50.52+08:00",
        "2021-10-13T08:20:50.52+08:00",
        "2020-01-02T22:20:50.52+07:00",
        "2020-03-03T11:39:50.52+07:00",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "datetime string")
    assert tuple(longest_streak(df).first()) == (2, "2021-10-12", "2021-10-13")


def test_days_are_utc_days(spark):
    texts = ["2021-10-12T23:30:00-05:00", "2021-10-13T23:00:00+08:00"]
    df = spark.createDataFrame([(t,) for t in texts], "datetime string")
    assert tuple(longest_streak(df).first()) == (1, "2021-10-13", "2021-10-13")


def test_null_and_bad_text_are_skipped(spark):
    df = spark.createDataFrame(
        [("a", None), ("a", "x"), ("a", moment(5)), ("b", None)], "repo_name string, datetime string"
    )
    got = {r[0]: tuple(r)[1:] for r in longest_streak(df, ["repo_name"]).collect()}
    assert got == {
        "a": (1, "1970-01-06", "1970-01-06"),
        "b": (0, "1970-01-01", "1970-01-01"),
    }


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.dictionaries(
        st.sampled_from("abcdef"),
        st.lists(st.integers(0, 60), min_size=1, max_size=40),
        min_size=1,
    )
)
def test_both_forms_against_brute_force(spark, groups):
    sqlfn.register(spark)
    expected = {}
    for g, days in groups.items():
        n, start, end = brute_force(set(days))
        expected[g] = (n, day_text(start), day_text(end))
    assert grouped(spark, groups) == expected
    df = spark.createDataFrame(list(groups.items()), "g string, days array<bigint>")
    sql = df.selectExpr("g", "streak_days(days)", "streak_start(days)", "streak_end(days)")
    assert {r[0]: tuple(r)[1:] for r in sql.collect()} == expected


def test_hot_group_is_reduced_before_its_window(spark, sf):
    """The window's input is one row per group and day, so its size is that of a calendar."""
    from checks import views

    plan = longest_streak(views.event_commits(spark, sf), ["repo_name"])._jdf.queryExecution()
    text = plan.executedPlan().toString()
    window = text.index("Window [row_number()")
    assert "HashAggregate(keys=[repo_name" in text[window:]
    assert text[window:].count("partial_min") == 1
