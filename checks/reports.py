"""Report queries."""

from annalist.operators.linecount import count_lines
from annalist.plans import reports
from annalist.sources import tables
from checks import views
from checks.functions import AS_OF
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

AUTHOR = "user7"
REPO = "AUTOMOBILE/NATION_7"
YEAR_OF = 1998
UNTIL = 2000
MONTHS = (1, 2, 3, 4)
SOURCES = ("src0", "src1")
EXTS = ("py", "js", "go", "html", "css")

_MINE = f"author_name = '{AUTHOR}'"
_IN_YEAR = f"{_MINE} AND {YEAR} = {YEAR_OF}"
_FIRST = f"SELECT repo_name, min({UNIX}) AS moment FROM f_commit WHERE {_MINE} GROUP BY repo_name"


_VIEW_TABLES = {"commits": "commit", "changes": "change", "tags": "tag", "active": "active"}
# Reports that are also run on loaded tables, where stored fields stand for parsed text.
_STORED = (
    "q_first_commit",
    "q_commits_per_year",
    "q_churn_topk",
    "q_streak_repo_top",
    "q_weekday",
    "q_repo_year_tz",
)


def _report(name, view, sql, run):
    @check(name, sql)
    def query(spark, sf_dir):
        return run(getattr(views, view)(spark, sf_dir))

    if name in _STORED:

        @check(f"stored_{name}", sql)
        def stored(spark, sf_dir):
            return run(tables.read_table(spark, _VIEW_TABLES[view], views.loaded(spark, sf_dir)))


_report(
    "q_first_commit",
    "commits",
    f"""SELECT author_name, author_email, {rfc3339('moment')} AS first_commit,
               {duration(f'{AS_OF} - moment')} AS duration
        FROM (SELECT author_name, author_email, min({UNIX}) AS moment FROM f_commit WHERE {_MINE}
              GROUP BY ALL ORDER BY moment, author_email LIMIT 1)""",
    lambda t: reports.first_commit(t, AUTHOR, AS_OF),
)
_report(
    "q_projects_per_year",
    "commits",
    f"""SELECT CAST(year(make_timestamp(moment * 1000000)) AS INTEGER) AS year, count(*) AS count
        FROM ({_FIRST}) GROUP BY 1""",
    lambda t: reports.projects_per_year(t, AUTHOR),
)
_report(
    "q_commits_per_year",
    "commits",
    f"""SELECT {YEAR} AS year, count(*) AS count FROM f_commit
        WHERE {_MINE} AND {YEAR} <= {UNTIL} GROUP BY 1""",
    lambda t: reports.commits_per_year(t, AUTHOR, UNTIL),
)
_report(
    "q_commits_per_day",
    "commits",
    f"""SELECT {YEAR} AS year, CAST(count(*) AS DOUBLE) / CAST(365 AS DOUBLE) AS count
        FROM f_commit WHERE {_MINE} AND {YEAR} <= {UNTIL} GROUP BY 1""",
    lambda t: reports.commits_per_day(t, AUTHOR, UNTIL),
)
_report(
    "q_active_days",
    "commits",
    f"""SELECT {YEAR} AS year, count(DISTINCT {DATEDAY}) AS count FROM f_commit
        WHERE {_MINE} AND {YEAR} <= {UNTIL} GROUP BY 1""",
    lambda t: reports.active_days(t, AUTHOR, UNTIL),
)
_report(
    "q_tags_per_year",
    "tags",
    f"SELECT {YEAR} AS year, count(*) AS count FROM f_tag WHERE {YEAR} <= {UNTIL} GROUP BY 1",
    lambda t: reports.tags_per_year(t, UNTIL),
)
_report(
    "q_most_tags",
    "tags",
    """SELECT repo_name, count(*) AS count FROM f_tag GROUP BY 1
       ORDER BY 2 DESC, 1 LIMIT 1""",
    reports.most_tags,
)
_report(
    "q_first_tag",
    "tags",
    f"SELECT {rfc3339(f'min({UNIX})')} AS first_tag FROM f_tag",
    reports.first_tag,
)
_report(
    "q_repos_active_in_year",
    "commits",
    f"""SELECT repo_name, {rfc3339(f'min({UNIX})')} AS created FROM f_commit
        WHERE {_IN_YEAR} GROUP BY 1""",
    lambda t: reports.repos_active_in_year(t, AUTHOR, YEAR_OF),
)
_report(
    "q_churn_topk",
    "changes",
    f"""SELECT ext, CAST(sum(insertion) AS BIGINT) AS insertion,
               CAST(sum(deletion) AS BIGINT) AS deletion
        FROM f_change WHERE {_IN_YEAR} AND ext <> '' GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 4""",
    lambda t: reports.churn_topk(t, AUTHOR, YEAR_OF, 4),
)
_report(
    "q_commits_by_hour",
    "commits",
    f"SELECT {HOUR} AS hour, count(*) AS count FROM f_commit WHERE {_IN_YEAR} GROUP BY 1",
    lambda t: reports.commits_by_hour(t, AUTHOR, YEAR_OF),
)
_report(
    "q_streak_global",
    "commits",
    f"""WITH f_mine AS (SELECT * FROM f_commit WHERE {_IN_YEAR})
        SELECT {day_text('s')} AS active_longest_start, {day_text('e')} AS active_longest_end,
               CAST(n AS BIGINT) AS active_longest_days
        FROM ({streaks('f_mine', "'all'")})""",
    lambda t: reports.streak_of_year(t, AUTHOR, YEAR_OF),
)
_report(
    "q_streak_repo_top",
    "commits",
    f"""WITH f_mine AS (SELECT * FROM f_commit WHERE {_IN_YEAR})
        SELECT grp AS repo_name, CAST(n AS BIGINT) AS active_longest_days
        FROM ({streaks('f_mine')}) ORDER BY n DESC, grp LIMIT 1""",
    lambda t: reports.repo_with_longest_streak(t, AUTHOR, YEAR_OF),
)
_report(
    "q_repos_created_in_year",
    "commits",
    f"""SELECT repo_name, {rfc3339('moment')} AS created FROM ({_FIRST})
        WHERE year(make_timestamp(moment * 1000000)) = 1995""",
    lambda t: reports.repos_created_in_year(t, AUTHOR, 1995),
)


@check(
    "q_snapshot_lookup",
    f"SELECT repo_name, ext, code, comments, blanks FROM f_snapshot WHERE repo_name IN {SOURCES}",
)
def q_snapshot_lookup(spark, sf_dir):
    counts = count_lines(views.sources(spark, sf_dir), (), views.COMMENT_PREFIXES)
    return reports.snapshot_of(counts, SOURCES)


_report(
    "q_language_dist",
    "changes",
    f"""SELECT ext, count(DISTINCT repo_name) AS count FROM f_change
        WHERE {_IN_YEAR} AND ext IN {EXTS} GROUP BY 1""",
    lambda t: reports.language_dist(t, AUTHOR, YEAR_OF, EXTS),
)
_report(
    "q_period_dist",
    "commits",
    f"SELECT {PERIOD} AS period, count(*) AS count FROM f_commit WHERE {_IN_YEAR} GROUP BY 1",
    lambda t: reports.period_dist(t, AUTHOR, YEAR_OF),
)
_report(
    "q_count_filtered",
    "commits",
    f"""SELECT count(*) AS count FROM f_commit
        WHERE {_IN_YEAR} AND repo_name = '{REPO}' AND {MONTH} IN {MONTHS}""",
    lambda t: reports.count_filtered(t, AUTHOR, YEAR_OF, REPO, MONTHS),
)
_report(
    "q_hour_one_repo",
    "commits",
    f"""SELECT {HOUR} AS hour, count(*) AS count FROM f_commit
        WHERE {_IN_YEAR} AND repo_name = '{REPO}' AND {MONTH} IN {MONTHS} GROUP BY 1""",
    lambda t: reports.commits_by_hour(t, AUTHOR, YEAR_OF, REPO, MONTHS),
)
_report(
    "q_churn_one_repo",
    "changes",
    f"""SELECT ext, CAST(sum(insertion) AS BIGINT) AS insertion,
               CAST(sum(deletion) AS BIGINT) AS deletion
        FROM f_change
        WHERE {_IN_YEAR} AND repo_name = '{REPO}' AND {MONTH} IN {MONTHS} AND ext <> ''
        GROUP BY 1""",
    lambda t: reports.churn_of_repo(t, AUTHOR, YEAR_OF, REPO, MONTHS),
)
_report(
    "q_weekday",
    "commits",
    f"SELECT {WEEKDAY} AS week, count(*) AS count FROM f_commit WHERE {_IN_YEAR} GROUP BY 1",
    lambda t: reports.commits_by_weekday(t, AUTHOR, YEAR_OF),
)
for _name, _weekend, _days in (
    ("q_hour_workday", False, "NOT IN (5, 6)"),
    ("q_hour_weekend", True, "IN (5, 6)"),
):
    _report(
        _name,
        "commits",
        f"""SELECT hour, CAST(sum(count) AS BIGINT) AS count FROM (
              SELECT {HOUR} AS hour, 0 AS count FROM f_commit
              UNION
              SELECT {HOUR} AS hour, count(*) AS count FROM f_commit
              WHERE {_IN_YEAR} AND {WEEKNUM} {_days} GROUP BY 1) GROUP BY hour""",
        lambda t, weekend=_weekend: reports.hours_filled(t, AUTHOR, YEAR_OF, weekend),
    )
_report(
    "q_by_month",
    "commits",
    f"SELECT {MONTH} AS month, count(*) AS count FROM f_commit WHERE {_IN_YEAR} GROUP BY 1",
    lambda t: reports.commits_by_month(t, AUTHOR, YEAR_OF),
)
_report(
    "q_popularity_total",
    "active",
    """SELECT CAST(sum(stars) AS BIGINT) AS stars, CAST(sum(forks) AS BIGINT) AS forks
       FROM f_active""",
    reports.popularity_total,
)
_report(
    "q_contributors",
    "commits",
    f"SELECT count(DISTINCT author_name) AS contributors FROM f_commit WHERE NOT {_MINE}",
    lambda t: reports.contributors(t, AUTHOR),
)
_report(
    "q_timezones",
    "commits",
    f"SELECT DISTINCT {TIMEZONE} AS timezone FROM f_commit",
    reports.timezones,
)
_report(
    "q_domains",
    "commits",
    "SELECT DISTINCT author_domain AS domain FROM f_commit",
    reports.domains,
)


@check(
    "q_top_starred",
    f"""SELECT repo_name, stars, {rfc3339('moment')} AS last_commit
        FROM f_active JOIN (SELECT repo_name, max({UNIX}) AS moment FROM f_commit
                            WHERE {_MINE} GROUP BY repo_name) USING (repo_name)
        ORDER BY stars DESC, repo_name LIMIT 10""",
)
def q_top_starred(spark, sf_dir):
    return reports.top_starred(views.active(spark, sf_dir), views.commits(spark, sf_dir), AUTHOR)


_report(
    "q_repo_year_tz",
    "commits",
    f"SELECT repo_name, {YEAR} AS year, {TIMEZONE} AS tz FROM f_commit",
    reports.repo_year_tz,
)
_report(
    "q_max_insertion",
    "changes",
    """SELECT ext, max(insertion) AS insertion FROM f_change GROUP BY 1
       ORDER BY 2 DESC, 1 LIMIT 1""",
    reports.max_insertion,
)
_report(
    "q_tags_until",
    "tags",
    f"SELECT repo_name, branch, datetime, tag FROM f_tag WHERE {YEAR} <= 1997",
    lambda t: reports.tags_until(t, 1997),
)
_report(
    "q_active_lookup",
    "active",
    f"SELECT repo_name, forks, stars FROM f_active WHERE repo_name = '{REPO}'",
    lambda t: reports.active_of(t, REPO),
)
_report(
    "q_active_first",
    "active",
    "SELECT repo_name, stars FROM f_active ORDER BY repo_name LIMIT 5",
    reports.first_active,
)
