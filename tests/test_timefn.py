from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annalist.functions import fields, sqlfn, timefn

ROWS = [
    # text, year, month, weekday, weeknum, dateday, hour, period, timestamp, timezone
    ("1999-12-31T23:59:59.125-03:30", 1999, 12, "Fri", 4, "1999-12-31", 23, "Evening", 946697399, "-03:30"),
    ("2016-02-29T00:00:00+05:45", 2016, 2, "Mon", 0, "2016-02-29", 0, "Midnight", 1456683300, "+05:45"),
    ("2003-07-06T18:30:15-11:00", 2003, 7, "Sun", 6, "2003-07-06", 18, "Afternoon", 1057555815, "-11:00"),
    ("1987-05-23T12:05:09.9+13:00", 1987, 5, "Sat", 5, "1987-05-23", 12, "Afternoon", 548723109, "+13:00"),
]
NAMES = ("year", "month", "weekday", "weeknum", "dateday", "hour", "period", "timestamp", "timezone")
SQL_NAMES = (
    "rfc_year",
    "rfc_month",
    "rfc_weekday",
    "weeknum",
    "dateday",
    "rfc_hour",
    "period",
    "rfc_timestamp",
    "timezone",
)
FUNCTIONS = [getattr(timefn, name) for name in NAMES]
INVALID = [
    "",
    "2021",
    "2021-10-12",
    "2021-10-12T14:20:50",
    "2021-10-12 14:20:50+08:00",
    "2021-02-30T00:00:00Z",
    "2021-10-12T24:00:00Z",
    "2021-10-12T14:60:00Z",
    "2021-10-12T14:20:61Z",
    "2021-10-12T14:20:50+24:00",
    "2021-10-12T14:20:50+08:60",
    "2021-10-12T14:20:50+0800",
    "2021-10-12T14:20:50.Z",
    "2021-10-12T14:20:50Z\n",
    " 2021-10-12T14:20:50Z",
    None,
]


def test_known_rows(values):
    assert values("string", [r[0] for r in ROWS], *FUNCTIONS) == [r[1:] for r in ROWS]


def test_unparseable_text_is_null(values):
    for row in values("string", INVALID, *FUNCTIONS):
        assert row == (None,) * len(FUNCTIONS)


def test_edges_of_valid_text(values):
    inputs = [
        "2021-10-12T14:20:50z",
        "2021-10-12t14:20:50Z",
        "2021-10-12T14:20:60Z",
        "2021-10-12T14:20:50-00:00",
        "2021-10-12T14:20:50.123456789123+23:59",
    ]
    got = values("string", inputs, timefn.timestamp, timefn.timezone, timefn.hour)
    noon = 1634048450
    assert got == [
        (noon, "+00:00", 14),
        (noon, "+00:00", 14),
        (noon + 9, "+00:00", 14),
        (noon, "+00:00", 14),
        (noon - 23 * 3600 - 59 * 60, "+23:59", 14),
    ]


def test_period_limits(values):
    inputs = [f"2021-10-12T{h:02d}:00:00Z" for h in (7, 8, 11, 12, 18, 19, 23, 0)]
    assert values("string", inputs, timefn.period) == [
        "Midnight",
        "Morning",
        "Morning",
        "Afternoon",
        "Afternoon",
        "Evening",
        "Evening",
        "Midnight",
    ]


def test_local_year_differs_from_utc_year(values):
    def utc_year(c):
        return timefn.year(timefn.timestamp_rfc3339(timefn.timestamp(c)))

    assert values("string", ["2018-01-01T02:00:00+08:00"], timefn.year, utc_year) == [(2018, 2017)]


def test_timestamp_rfc3339(values):
    inputs = [1647272093, 0, -1, None]
    assert values("bigint", inputs, timefn.timestamp_rfc3339) == [
        "2022-03-14T15:34:53+00:00",
        "1970-01-01T00:00:00+00:00",
        "1969-12-31T23:59:59+00:00",
        None,
    ]


@pytest.mark.parametrize(
    "age, text",
    [
        (0, "0s"),
        (59, "59s"),
        (3600, "1h"),
        (86400, "1day"),
        (172800, "2days"),
        (108120, "1day 6h 2m"),
        (2630016, "1month"),
        (31557600, "1year"),
        (31557600 * 5 + 86400 * 17 + 3600 * 7 + 60 * 53 + 36, "5years 17days 7h 53m 36s"),
        (-1, None),
    ],
)
def test_duration(values, age, text):
    assert values("bigint", [1_000_000_000 - age], lambda c: timefn.duration(c, 1_000_000_000)) == [
        text
    ]


def test_duration_counts_from_now_by_default(spark):
    sqlfn.register(spark)
    now = F.unix_seconds(F.current_timestamp())
    row = spark.range(1).select(timefn.duration(now - 61), F.expr(
        "duration(unix_seconds(current_timestamp()) - 61)"
    ))
    assert tuple(row.first()) == ("1m 1s", "1m 1s")


def test_sql_functions_agree(spark):
    sqlfn.register(spark)
    inputs = [(r[0],) for r in ROWS] + [(text,) for text in INVALID]
    df = spark.createDataFrame(inputs, "x string")
    native = df.select(*[f("x").alias(n) for f, n in zip(FUNCTIONS, NAMES)]).collect()
    sql = df.selectExpr(*[f"{s}(x) AS {n}" for s, n in zip(SQL_NAMES, NAMES)]).collect()
    assert native == sql


def test_sql_durations_agree(spark):
    sqlfn.register(spark)
    df = spark.createDataFrame([(n * 7919 * 13 % 200_000_000,) for n in range(200)], "x bigint")
    both = df.select(
        timefn.duration("x", 150_000_000).alias("a"),
        F.expr("duration(x, 150000000)").alias("b"),
        timefn.timestamp_rfc3339("x").alias("c"),
        F.expr("timestamp_rfc3339(x)").alias("d"),
    ).collect()
    assert all(r.a == r.b and r.c == r.d for r in both)


def test_session_time_zone_does_not_matter(spark, values):
    before = spark.conf.get("spark.sql.session.timeZone")
    inputs = ["2021-03-14T02:30:00-05:00", "2021-11-07T01:30:00+01:00"]
    expected = values("string", inputs, *FUNCTIONS)
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert values("string", inputs, *FUNCTIONS) == expected
        assert values("bigint", [1615703400], timefn.timestamp_rfc3339) == [
            "2021-03-14T06:30:00+00:00"
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_stored_fields_equal_parsed_fields(spark):
    df = spark.createDataFrame([(r[0],) for r in ROWS] + [("",)], "datetime string")
    stored = fields.enrich(df)
    names = ("year", "month", "hour", "weeknum", "weekday", "dateday", "period", "timezone", "seconds")
    both = [
        [tuple(r) for r in t.select(*[getattr(fields, n)(t).alias(n) for n in names]).collect()]
        for t in (df, stored)
    ]
    assert both[0] == both[1]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.datetimes(datetime(1, 1, 2), datetime(9999, 12, 30)),
            st.integers(-23 * 60 - 59, 23 * 60 + 59),
        ),
        min_size=20,
        max_size=60,
    )
)
def test_against_python(values, moments):
    inputs, expected = [], []
    for at, offset in moments:
        at = at.replace(microsecond=0, tzinfo=timezone(timedelta(minutes=offset)))
        sign, minutes = ("-" if offset < 0 else "+"), abs(offset)
        zone = f"{sign}{minutes // 60:02d}:{minutes % 60:02d}"
        inputs.append(at.strftime("%Y").zfill(4) + at.strftime("-%m-%dT%H:%M:%S") + zone)
        zero = datetime(1970, 1, 1, tzinfo=timezone.utc)
        expected.append((at.year, at.month, at.weekday(), at.hour, (at - zero) // timedelta(seconds=1)))
    got = values(
        "string", inputs, timefn.year, timefn.month, timefn.weeknum, timefn.hour, timefn.timestamp
    )
    assert got == expected
