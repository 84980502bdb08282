"""Result shaping and the report runner."""

from functools import reduce

from pyspark.sql import functions as F

from annalist.functions import timefn
from annalist.operators import results
from annalist.plans import reports
from annalist.plans.report_run import run_report
from annalist.sources import shared, tables
from checks import views
from checks.registry import HOUR, PERIOD, UNIX, WEEKNUM, YEAR, check, day_text, rfc3339, streaks

AUTHOR = "user7"

_BY_HOUR = f"SELECT {HOUR} AS hour, count(*) AS count FROM f_commit GROUP BY 1"


def _by_hour(commits):
    return commits.groupBy(timefn.hour("datetime").alias("hour")).agg(
        F.count(F.lit(1)).alias("count")
    )


@check(
    "result_arrays",
    f"""SELECT list(hour ORDER BY hour) AS hour, list(count ORDER BY hour) AS count
        FROM ({_BY_HOUR})""",
)
def result_arrays(spark, sf_dir):
    return results.column_arrays(_by_hour(views.commits(spark, sf_dir)), ["hour"])


def _hours(days):
    return f"""SELECT {HOUR} AS label,
                      count(*) FILTER (author_name = '{AUTHOR}' AND {YEAR} = 1998
                                       AND {WEEKNUM} {days}) AS count
               FROM f_commit GROUP BY 1"""


@check(
    "result_series",
    f"""SELECT w.label, w.count AS workday, e.count AS weekend
        FROM ({_hours('NOT IN (5, 6)')}) w LEFT JOIN ({_hours('IN (5, 6)')}) e
          ON w.label = e.label""",
)
def result_series(spark, sf_dir):
    commits = views.commits(spark, sf_dir)
    statements = [reports.hours_filled(commits, AUTHOR, 1998, weekend) for weekend in (False, True)]
    return results.chart_series(
        statements, "${hour}", {"workday": "${0:count}", "weekend": "${1:count}"}
    )


@check(
    "result_series_partial",
    f"""SELECT coalesce(a.label, b.label) AS label, a.count AS early, b.count AS late
        FROM (SELECT nullif(branch || {YEAR}, 'main1995') AS label, count(*) AS count
              FROM f_commit WHERE {YEAR} <= 1996 GROUP BY 1) a
        FULL JOIN (SELECT nullif(branch || {YEAR}, 'main1998') AS label, count(*) AS count
                   FROM f_commit WHERE {YEAR} >= 1995 GROUP BY 1) b
          ON a.label IS NOT DISTINCT FROM b.label""",
)
def result_series_partial(spark, sf_dir):
    """Statements whose labels overlap in part, with a NULL label in each."""
    commits = views.commits(spark, sf_dir).withColumn("year", timefn.year("datetime"))

    def counted(rows, gone):
        label = F.concat("branch", F.col("year").cast("string"))
        return rows.groupBy(F.nullif(label, F.lit(gone)).alias("label")).agg(F.count(F.lit(1)).alias("count"))

    statements = [
        counted(commits.filter("year <= 1996"), "main1995"),
        counted(commits.filter("year >= 1995"), "main1998"),
    ]
    return results.chart_series(statements, "${label}", {"early": "${0:count}", "late": "${1:count}"})


@check(
    "result_chart_arrays",
    f"""SELECT list_concat(['hour of day'], list(CAST(w.label AS STRING) ORDER BY w.label)) AS labels,
               list(CAST(w.count AS DOUBLE) ORDER BY w.label) AS workday,
               list_concat(list(CAST(e.count AS DOUBLE) ORDER BY w.label),
                           [CAST(0 AS DOUBLE)]) AS weekend,
               CAST([] AS DOUBLE[]) AS nothing
        FROM ({_hours('NOT IN (5, 6)')}) w JOIN ({_hours('IN (5, 6)')}) e ON w.label = e.label""",
)
def result_chart_arrays(spark, sf_dir):
    """Labels and datasets made of bindings, literals and an unknown column."""
    commits = views.commits(spark, sf_dir)
    statements = [reports.hours_filled(commits, AUTHOR, 1998, weekend) for weekend in (False, True)]
    return results.chart_arrays(
        statements,
        [["hour"], ["hour"]],
        ["hour of day", "${hour}"],
        {"workday": ["${0:count}"], "weekend": ["${1:count}", 0], "nothing": ["${2:count}"]},
    )


@check(
    "result_share",
    f"""SELECT period, count,
               concat(printf('%.2f', CAST(count AS DOUBLE)
                                     / CAST(sum(count) OVER () AS DOUBLE) * 100), '%') AS share
        FROM (SELECT {PERIOD} AS period, count(*) AS count FROM f_commit
              WHERE author_name = '{AUTHOR}' AND {YEAR} = 1998 GROUP BY 1)""",
)
def result_share(spark, sf_dir):
    periods = reports.period_dist(views.commits(spark, sf_dir), AUTHOR, 1998)
    return results.with_share(periods, "count")


@check(
    "result_round2",
    f"""SELECT {YEAR} AS year,
               floor(CAST(count(*) AS DOUBLE) / CAST(365 AS DOUBLE) * 100 + CAST(0.5 AS DOUBLE))
                 / CAST(100 AS DOUBLE) AS count
        FROM f_commit WHERE author_name = '{AUTHOR}' GROUP BY 1""",
)
def result_round2(spark, sf_dir):
    mean = reports.commits_per_day(views.commits(spark, sf_dir), AUTHOR, 9999)
    return mean.select("year", results.round2("count").alias("count"))


@check(
    "report_run",
    f"""SELECT query, CAST(statement AS INTEGER) AS statement, count(*) AS results,
               CAST(sum(count) AS BIGINT) AS total
        FROM (SELECT 'commits-per-year' AS query, 0 AS statement, count(*) AS count
              FROM f_commit GROUP BY {YEAR}
              UNION ALL
              SELECT 'hours', 0, count(*) FILTER ({WEEKNUM} NOT IN (5, 6))
              FROM f_commit GROUP BY {HOUR}
              UNION ALL
              SELECT 'hours', 1, count(*) FILTER ({WEEKNUM} IN (5, 6))
              FROM f_commit GROUP BY {HOUR}
              UNION ALL
              SELECT 'tags', 0, count(*) FROM f_tag GROUP BY repo_name)
        GROUP BY query, statement""",
)
def report_run(spark, sf_dir):
    """Three queries, one of two statements, over registered views; the size of each result."""
    views.commits(spark, sf_dir).createOrReplaceTempView("report_commit")
    views.tags(spark, sf_dir).createOrReplaceTempView("report_tag")
    hours = (
        "SELECT rfc_hour(datetime) AS hour, count_if(weeknum(datetime) {}) AS count"
        " FROM report_commit GROUP BY 1"
    )
    stored = run_report(
        spark,
        {
            "commits-per-year": [
                "SELECT rfc_year(datetime) AS commit_year, count(1) AS count"
                " FROM report_commit GROUP BY 1 ORDER BY 1;"
            ],
            "hours": [hours.format("NOT IN (5, 6)"), hours.format("IN (5, 6)")],
            "tags": ["SELECT repo_name, count(1) AS count FROM report_tag GROUP BY repo_name"],
        },
        shared.folder(spark, "report"),
    )
    counted = [
        result.agg(F.count(F.lit(1)).alias("results"), F.sum("count").alias("total")).select(
            F.lit(name).alias("query"), F.lit(index).alias("statement"), "results", "total"
        )
        for name, statements in stored.items()
        for index, result in enumerate(statements)
    ]
    return reduce(lambda a, b: a.unionByName(b), counted)


@check(
    "result_array_blocks",
    """SELECT CAST((n - 1) // 700 AS BIGINT) AS block, CAST((n - 1) // 700 * 700 AS BIGINT) AS first,
              list(hash ORDER BY n) AS hash, list(datetime ORDER BY n) AS datetime
       FROM (SELECT hash, datetime, row_number() OVER (ORDER BY datetime, hash) AS n FROM f_commit)
       GROUP BY ALL""",
)
def result_array_blocks(spark, sf_dir):
    """All commits in order of time, ungrouped, as arrays of 700."""
    commits = views.commits(spark, sf_dir).select("hash", "datetime")
    return results.array_blocks(commits, ["datetime", "hash"], rows=700)


#: Statements as written for the history tables themselves.
_HISTORY_REPORT = {
    "years": ["SELECT year(datetime) AS y, count(1) AS n FROM 'report_db.commit' GROUP BY y ORDER BY y;"],
    "hours": [
        "SELECT hour(datetime) AS h, count(1) AS n FROM 'report_db.commit' WHERE weeknum(datetime) IN (5, 6) GROUP BY h",
        """SELECT h, sum(n) AS n FROM (SELECT period(datetime) AS h, count(DISTINCT author_name) AS n
           FROM 'report_db.commit' WHERE author_name != 'year(datetime)' GROUP BY period(datetime)) AS a GROUP BY h""",
    ],
    "streaks": [
        """SELECT author_name, active_longest_days(datetime) AS n, active_longest_start(datetime) AS first_day
           FROM 'report_db.commit' GROUP BY author_name"""
    ],
    "first": [
        """SELECT author_name, timestamp_rfc3339(min_ts) AS first_commit FROM (
             SELECT author_name, min(timestamp(datetime)) AS min_ts FROM 'report_db.commit'
             GROUP BY author_name ORDER BY min_ts, author_name LIMIT 3) AS a"""
    ],
}


@check(
    "report_shared_scan",
    f"""SELECT 'years' AS query, CAST({YEAR} AS VARCHAR) AS label, count(*) AS n FROM f_commit GROUP BY 2
        UNION ALL SELECT 'hours', CAST({HOUR} AS VARCHAR), count(*) FROM f_commit WHERE {WEEKNUM} IN (5, 6) GROUP BY 2
        UNION ALL SELECT 'periods', {PERIOD}, count(DISTINCT author_name) FROM f_commit GROUP BY 2
        UNION ALL SELECT 'streaks', grp || ' ' || {day_text("s")}, n FROM ({streaks("f_commit", "author_name")})
        UNION ALL SELECT 'first', author_name || ' ' || {rfc3339("ts")}, CAST(1 AS BIGINT)
        FROM (SELECT author_name, min({UNIX}) AS ts FROM f_commit GROUP BY 1 ORDER BY 2, 1 LIMIT 3)""",
)
def report_shared_scan(spark, sf_dir):
    """A report of five statements in the history dialect over one scan of the commits."""
    base = shared.folder(spark, "report-db")
    tables.write_table("commit", views.commits(spark, sf_dir), base)
    tables.register_database(spark, "report_db", base)
    out = shared.folder(spark, "report")
    stored = run_report(spark, _HISTORY_REPORT, out, share=["report_db.commit"])
    parts = [
        ("years", stored["years"][0], F.col("y"), F.col("n")),
        ("hours", stored["hours"][0], F.col("h"), F.col("n")),
        ("periods", stored["hours"][1], F.col("h"), F.col("n")),
        ("streaks", stored["streaks"][0], F.concat_ws(" ", "author_name", "first_day"), F.col("n")),
        ("first", stored["first"][0], F.concat_ws(" ", "author_name", "first_commit"), F.lit(1)),
    ]
    shown = [
        frame.select(F.lit(name).alias("query"), label.cast("string").alias("label"), n.cast("long").alias("n"))
        for name, frame, label, n in parts
    ]
    return reduce(lambda a, b: a.unionByName(b), shown)
