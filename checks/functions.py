"""Time functions and streak aggregates."""

from pyspark.sql import functions as F

from annalist.functions import sqlfn, timefn
from annalist.operators import streak_state
from annalist.operators.streak import longest_streak
from annalist.sources import shared
from checks import views
from checks.registry import (
    DATEDAY,
    HOUR,
    MONTH,
    PERIOD,
    TIMEZONE,
    UNIX,
    WEEKDAY,
    WEEKNUM,
    YEAR,
    check,
    day_text,
    duration,
    rfc3339,
    streaks,
)

AS_OF = 1009843200

_OF_DATETIME = {
    "year": YEAR,
    "month": MONTH,
    "weekday": WEEKDAY,
    "weeknum": WEEKNUM,
    "dateday": DATEDAY,
    "hour": HOUR,
    "period": PERIOD,
    "timestamp": UNIX,
    "timezone": TIMEZONE,
}


def _of_datetime(name):
    function = getattr(timefn, name)

    @check(f"fn_{name}", f"SELECT hash, datetime, {_OF_DATETIME[name]} AS result FROM f_commit")
    def run(spark, sf_dir):
        return views.commits(spark, sf_dir).select(
            "hash", "datetime", function("datetime").alias("result")
        )


for _name in _OF_DATETIME:
    _of_datetime(_name)


@check(
    "fn_duration_asof",
    f"SELECT hash, {duration(f'{AS_OF} - {UNIX}')} AS result FROM f_commit",
)
def fn_duration_asof(spark, sf_dir):
    return views.commits(spark, sf_dir).select(
        "hash", timefn.duration(timefn.timestamp("datetime"), AS_OF).alias("result")
    )


@check("fn_timestamp_rfc3339", f"SELECT hash, {rfc3339(UNIX)} AS result FROM f_commit")
def fn_timestamp_rfc3339(spark, sf_dir):
    return views.commits(spark, sf_dir).select(
        "hash", timefn.timestamp_rfc3339(timefn.timestamp("datetime")).alias("result")
    )


@check(
    "fn_sql",
    f"""SELECT hash, {YEAR} AS y, {MONTH} AS m, {WEEKDAY} AS wd, {WEEKNUM} AS wn,
               {DATEDAY} AS dd, {HOUR} AS h, {PERIOD} AS p, {UNIX} AS ts, {TIMEZONE} AS tz,
               {duration(f'{AS_OF} - {UNIX}')} AS age, {rfc3339(UNIX)} AS utc
        FROM f_commit""",
)
def fn_sql(spark, sf_dir):
    """All time functions through SQL text."""
    sqlfn.register(spark)
    return views.commits(spark, sf_dir).selectExpr(
        "hash",
        "rfc_year(datetime) AS y",
        "rfc_month(datetime) AS m",
        "rfc_weekday(datetime) AS wd",
        "weeknum(datetime) AS wn",
        "dateday(datetime) AS dd",
        "rfc_hour(datetime) AS h",
        "period(datetime) AS p",
        "rfc_timestamp(datetime) AS ts",
        "timezone(datetime) AS tz",
        f"duration(rfc_timestamp(datetime), {AS_OF}) AS age",
        "timestamp_rfc3339(rfc_timestamp(datetime)) AS utc",
    )


def _streak_column(name, column, expression):
    @check(
        f"agg_longest_{name}",
        f"SELECT grp AS repo_name, {expression} AS {column} FROM ({streaks('f_event_commit')})",
    )
    def run(spark, sf_dir):
        return longest_streak(views.event_commits(spark, sf_dir), ["repo_name"]).select(
            "repo_name", column
        )


_streak_column("days", "active_longest_days", "CAST(n AS BIGINT)")
_streak_column("start", "active_longest_start", day_text("s"))
_streak_column("end", "active_longest_end", day_text("e"))


@check(
    "agg_streak_sql",
    f"""SELECT grp AS repo_name, CAST(n AS BIGINT) AS n, {day_text('s')} AS first_day,
               {day_text('e')} AS last_day
        FROM ({streaks('f_event_commit')})""",
)
def agg_streak_sql(spark, sf_dir):
    sqlfn.register(spark)
    days = views.event_commits(spark, sf_dir).selectExpr(
        "repo_name", "rfc_utc_day(datetime) AS day"
    )
    return (
        days.distinct()
        .groupBy("repo_name")
        .agg(F.collect_list("day").alias("days"))
        .selectExpr(
            "repo_name",
            "streak_days(days) AS n",
            "streak_start(days) AS first_day",
            "streak_end(days) AS last_day",
        )
    )


_SETS = (("repo_name", "author_name"), ("repo_name", "year"), ("author_name",), ("year",), ())
_KEYS = ("repo_name", "author_name", "year")


def _set_twin(one):
    """The streaks of one grouping, with the columns that it leaves out as NULL."""
    shown = ", ".join(f"{k if k in one else 'NULL'} AS {k}" for k in _KEYS)
    number = sum(1 << (2 - n) for n, k in enumerate(_KEYS) if k not in one)
    part = ", ".join(one) or "1"
    return f"""
      SELECT CAST({number} AS BIGINT) AS "grouping", {shown}, CAST(n AS BIGINT) AS active_longest_days,
             {day_text("s")} AS active_longest_start, {day_text("e")} AS active_longest_end
      FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY n DESC, s) AS place
            FROM (SELECT {", ".join((*one, "count(*) AS n, min(day) AS s, max(day) AS e"))}
                  FROM (SELECT *, day - row_number() OVER (PARTITION BY {part} ORDER BY day) AS run
                        FROM (SELECT DISTINCT {", ".join((*one, "day"))} FROM days))
                  GROUP BY {", ".join((*one, "run"))}))
      WHERE place = 1"""


@check(
    "agg_streak_rollup",
    f"""WITH days AS (SELECT repo_name, author_name, {YEAR} AS year, {UNIX} // 86400 AS day FROM f_commit)
        {" UNION ALL ".join(map(_set_twin, _SETS))}""",
)
def agg_streak_rollup(spark, sf_dir):
    """Five groupings at once from one state of the commits."""
    commits = views.commits(spark, sf_dir).withColumn("year", timefn.year("datetime"))
    found = streak_state.streak_rollup(commits, _SETS)
    return found.withColumn("grouping", F.col("grouping").cast("long"))


@check(
    "agg_streak_merge",
    f"""SELECT grp AS repo_name, CAST(n AS BIGINT) AS active_longest_days,
               {day_text("s")} AS active_longest_start, {day_text("e")} AS active_longest_end
        FROM ({streaks("f_event_commit")})""",
)
def agg_streak_merge(spark, sf_dir):
    """Stored states of two halves of the events, merged without the events."""
    events = views.event_commits(spark, sf_dir)
    halves = []
    for odd in (0, 1):
        path = shared.folder(spark, "streak-state")
        half = events.filter(F.crc32("datetime") % 2 == odd)
        streak_state.streak_state(half, ["repo_name"]).write.parquet(path)
        halves.append(spark.read.parquet(path))
    merged = streak_state.merge_states(halves, ["repo_name"])
    return streak_state.longest_of_state(merged, ["repo_name"])
