"""Report questions asked in SQL over registered tables give what ``reports`` gives."""

import pytest

from annalist.functions import sqlfn
from annalist.operators.streak import longest_streak
from annalist.plans import reports
from annalist.sources import shared, tables
from checks import views

MINE = "author_name = 'user7'"
IN_YEAR = f"{MINE} AND rfc_year(datetime) = 1998"


@pytest.fixture(scope="module")
def db(spark, sf):
    base = shared.folder(spark, "surface")
    tables.write_table("commit", views.commits(spark, sf), base)
    tables.write_table("change", views.changes(spark, sf), base)
    tables.write_table("tag", views.tags(spark, sf), base)
    tables.write_table("active", views.active(spark, sf), base)
    tables.register_database(spark, "surface", base)
    sqlfn.register(spark)
    return {n: spark.table(f"surface.{n}") for n in ("commit", "change", "tag", "active")}


QUESTIONS = {
    "age of the first commit": (
        f"""SELECT author_name, author_email, timestamp_rfc3339(at) AS first_commit,
                   duration(at, 1009843200) AS duration
            FROM (SELECT author_name, author_email, min(rfc_timestamp(datetime)) AS at
                  FROM surface.commit WHERE {MINE} GROUP BY author_name, author_email
                  ORDER BY at, author_email LIMIT 1) AS a""",
        lambda t: reports.first_commit(t["commit"], "user7", 1009843200),
    ),
    "group by an alias of a function of an aggregate": (
        f"""SELECT rfc_year(timestamp_rfc3339(a.at)) AS year, count(a.repo_name) AS count
            FROM (SELECT repo_name, min(rfc_timestamp(datetime)) AS at FROM surface.commit
                  WHERE {MINE} GROUP BY repo_name) AS a
            GROUP BY year ORDER BY year""",
        lambda t: reports.projects_per_year(t["commit"], "user7"),
    ),
    "ratio": (
        f"""SELECT rfc_year(datetime) AS year, count(1) / 365.0D AS count FROM surface.commit
            WHERE {MINE} AND rfc_year(datetime) <= 2000 GROUP BY year ORDER BY year""",
        lambda t: reports.commits_per_day(t["commit"], "user7", 2000),
    ),
    "distinct days": (
        f"""SELECT year, count(DISTINCT(day)) AS count
            FROM (SELECT rfc_year(datetime) AS year, dateday(datetime) AS day
                  FROM surface.commit WHERE {MINE} AND rfc_year(datetime) <= 2000) AS a
            GROUP BY year""",
        lambda t: reports.active_days(t["commit"], "user7", 2000),
    ),
    "function of an aggregate": (
        "SELECT timestamp_rfc3339(min(rfc_timestamp(datetime))) AS first_tag FROM surface.tag",
        lambda t: reports.first_tag(t["tag"]),
    ),
    "week order": (
        f"""SELECT week, count FROM (
              SELECT rfc_weekday(datetime) AS week, weeknum(datetime) AS n, count(1) AS count
              FROM surface.commit WHERE {IN_YEAR} GROUP BY n, week) AS a ORDER BY n""",
        lambda t: reports.commits_by_weekday(t["commit"], "user7", 1998),
    ),
    "upper-case names": (
        f"""SELECT RFC_HOUR(datetime) AS hour, COUNT(1) AS count FROM surface.commit
            WHERE {IN_YEAR} AND RFC_MONTH(datetime) IN (1, 2, 3) GROUP BY hour ORDER BY hour""",
        lambda t: reports.commits_by_hour(t["commit"], "user7", 1998, months=(1, 2, 3)),
    ),
    "zero fill by union": (
        f"""SELECT hour, sum(count) AS count FROM (
              SELECT rfc_hour(datetime) AS hour, 0 AS count FROM surface.commit
              UNION
              SELECT rfc_hour(datetime) AS hour, count(1) AS count FROM surface.commit
              WHERE {IN_YEAR} AND weeknum(datetime) NOT IN (5, 6) GROUP BY hour) AS a
            GROUP BY hour ORDER BY hour""",
        lambda t: reports.hours_filled(t["commit"], "user7", 1998, False),
    ),
    "period": (
        f"""SELECT period(datetime) AS period, count(1) AS count FROM surface.commit
            WHERE {IN_YEAR} GROUP BY period""",
        lambda t: reports.period_dist(t["commit"], "user7", 1998),
    ),
    "time zones": (
        "SELECT DISTINCT(timezone(datetime)) AS timezone FROM surface.commit ORDER BY timezone",
        lambda t: reports.timezones(t["commit"]),
    ),
    "left join with a filter above": (
        f"""SELECT r.repo_name, stars, timestamp_rfc3339(at) AS last_commit
            FROM surface.active AS r
            LEFT JOIN (SELECT repo_name, author_name, max(rfc_timestamp(datetime)) AS at
                       FROM surface.commit GROUP BY repo_name, author_name) AS a
              ON a.repo_name = r.repo_name
            WHERE {MINE} ORDER BY stars DESC, r.repo_name LIMIT 10""",
        lambda t: reports.top_starred(t["active"], t["commit"], "user7"),
    ),
    "streak of a year": (
        f"""SELECT streak_start(collect_set(day)) AS active_longest_start,
                   streak_end(collect_set(day)) AS active_longest_end,
                   streak_days(collect_set(day)) AS active_longest_days
            FROM (SELECT DISTINCT rfc_utc_day(datetime) AS day FROM surface.commit
                  WHERE {IN_YEAR}) AS a""",
        lambda t: reports.streak_of_year(t["commit"], "user7", 1998),
    ),
    "streak straight from a group": (
        """SELECT repo_name, streak_days(collect_set(rfc_utc_day(datetime))) AS active_longest_days,
                  streak_start(collect_set(rfc_utc_day(datetime))) AS active_longest_start,
                  streak_end(collect_set(rfc_utc_day(datetime))) AS active_longest_end
           FROM surface.commit GROUP BY repo_name""",
        lambda t: longest_streak(t["commit"], ["repo_name"]),
    ),
    "streak of nothing": (
        """SELECT streak_start(collect_set(rfc_utc_day(datetime))) AS active_longest_start,
                  streak_end(collect_set(rfc_utc_day(datetime))) AS active_longest_end,
                  streak_days(collect_set(rfc_utc_day(datetime))) AS active_longest_days
           FROM surface.commit WHERE author_name = 'nobody'""",
        lambda t: reports.streak_of_year(t["commit"], "nobody", 1998),
    ),
    "partition column": (
        f"""SELECT ext, sum(insertion) AS insertion, sum(deletion) AS deletion
            FROM surface.change WHERE {MINE} AND commit_year = 1998 AND ext != ''
            GROUP BY ext ORDER BY deletion DESC, ext LIMIT 8""",
        lambda t: reports.churn_topk(t["change"], "user7", 1998, 8),
    ),
}


@pytest.mark.parametrize("question", QUESTIONS)
def test_question(spark, db, question):
    sql, report = QUESTIONS[question]
    asked, built = spark.sql(sql), report(db)
    columns = sorted(built.columns)
    assert sorted(asked.columns) == columns
    got = sorted((tuple(r) for r in asked.select(columns).collect()), key=repr)
    assert got == sorted((tuple(r) for r in built.select(columns).collect()), key=repr)
    assert got


def test_sql_functions_stay_in_codegen(spark, db):
    plan = spark.sql(
        "SELECT rfc_hour(datetime) AS h, count(1) AS n FROM surface.commit"
        " WHERE period(datetime) = 'Morning' GROUP BY h"
    )
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in text and "*(1)" in text
