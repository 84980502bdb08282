"""Report queries over the history tables.

Each takes stored tables, or any DataFrames with the same columns, and returns a DataFrame.
An author and year filter reaches the scan: on a stored table the year is the partition
column. Top-k results have a full order, so they are the same in every run.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import fields, timefn
from annalist.operators.streak import longest_streak


def _of(df: DataFrame, author=None, year=None, until=None, repo=None, months=None) -> DataFrame:
    if author is not None:
        df = df.filter(F.col("author_name") == author)
    if repo is not None:
        df = df.filter(F.col("repo_name") == repo)
    if year is not None:
        df = df.filter(fields.year(df) == year)
    if until is not None:
        df = df.filter(fields.year(df) <= until)
    if months is not None:
        df = df.filter(fields.month(df).isin(list(months)))
    return df


def _rows():
    return F.count(F.lit(1))


def _first_seen(commits: DataFrame, *by: str) -> DataFrame:
    return commits.groupBy(*by).agg(F.min(fields.seconds(commits)).alias("first_at"))


def first_commit(commits: DataFrame, author: str, as_of: "int | None" = None) -> DataFrame:
    """First commit of an author over all mail addresses, with its age."""
    return (
        _first_seen(_of(commits, author), "author_name", "author_email")
        .orderBy(F.col("first_at").asc_nulls_last(), "author_email")
        .limit(1)
        .select(
            "author_name",
            "author_email",
            timefn.timestamp_rfc3339("first_at").alias("first_commit"),
            timefn.duration("first_at", as_of).alias("duration"),
        )
    )


def projects_per_year(commits: DataFrame, author: str) -> DataFrame:
    """Repositories by the UTC year of the author's first commit in them."""
    first = _first_seen(_of(commits, author), "repo_name")
    return (
        first.groupBy(F.year(timefn.utc_clock("first_at")).alias("year"))
        .agg(F.count("repo_name").alias("count"))
        .orderBy("year")
    )


def commits_per_year(commits: DataFrame, author: str, until: int) -> DataFrame:
    mine = _of(commits, author, until=until)
    return mine.groupBy(fields.year(mine).alias("year")).agg(_rows().alias("count")).orderBy("year")


def commits_per_day(commits: DataFrame, author: str, until: int) -> DataFrame:
    """Mean commits per day of each year, a year taken as 365 days."""
    return commits_per_year(commits, author, until).select(
        "year", (F.col("count") / F.lit(365.0)).alias("count")
    )


def active_days(commits: DataFrame, author: str, until: int) -> DataFrame:
    mine = _of(commits, author, until=until)
    return (
        mine.groupBy(fields.year(mine).alias("year"))
        .agg(F.count_distinct(fields.local(mine).cast("date")).alias("count"))
        .orderBy("year")
    )


def tags_per_year(tags: DataFrame, until: int) -> DataFrame:
    some = _of(tags, until=until)
    return some.groupBy(fields.year(some).alias("year")).agg(_rows().alias("count")).orderBy("year")


def most_tags(tags: DataFrame) -> DataFrame:
    return (
        tags.groupBy("repo_name")
        .agg(_rows().alias("count"))
        .orderBy(F.col("count").desc(), "repo_name")
        .limit(1)
    )


def first_tag(tags: DataFrame) -> DataFrame:
    return tags.agg(F.min(fields.seconds(tags)).alias("at")).select(
        timefn.timestamp_rfc3339("at").alias("first_tag")
    )


def repos_active_in_year(commits: DataFrame, author: str, year: int) -> DataFrame:
    """Repositories the author worked on in a year, by their first commit in it."""
    return (
        _first_seen(_of(commits, author, year), "repo_name")
        .orderBy("first_at", "repo_name")
        .select("repo_name", timefn.timestamp_rfc3339("first_at").alias("created"))
    )


def churn_topk(changes: DataFrame, author: str, year: int, k: int) -> DataFrame:
    return (
        _of(changes, author, year)
        .filter(F.col("ext") != "")
        .groupBy("ext")
        .agg(F.sum("insertion").alias("insertion"), F.sum("deletion").alias("deletion"))
        .orderBy(F.col("deletion").desc(), "ext")
        .limit(k)
    )


def commits_by_hour(
    commits: DataFrame,
    author: str,
    year: int,
    repo: "str | None" = None,
    months: "Sequence[int] | None" = None,
) -> DataFrame:
    mine = _of(commits, author, year, repo=repo, months=months)
    return mine.groupBy(fields.hour(mine).alias("hour")).agg(_rows().alias("count")).orderBy("hour")


def streak_of_year(commits: DataFrame, author: str, year: int) -> DataFrame:
    return longest_streak(_of(commits, author, year)).select(
        "active_longest_start", "active_longest_end", "active_longest_days"
    )


def repo_with_longest_streak(commits: DataFrame, author: str, year: int) -> DataFrame:
    return (
        longest_streak(_of(commits, author, year), ["repo_name"])
        .select("repo_name", "active_longest_days")
        .orderBy(F.col("active_longest_days").desc(), "repo_name")
        .limit(1)
    )


def repos_created_in_year(commits: DataFrame, author: str, year: int) -> DataFrame:
    """Repositories whose first commit by the author falls in a UTC year."""
    return (
        _first_seen(_of(commits, author), "repo_name")
        .filter(F.year(timefn.utc_clock("first_at")) == year)
        .orderBy("first_at", "repo_name")
        .select("repo_name", timefn.timestamp_rfc3339("first_at").alias("created"))
    )


def snapshot_of(snapshot: DataFrame, repos: Sequence[str]) -> DataFrame:
    return snapshot.filter(F.col("repo_name").isin(list(repos))).select(
        "repo_name", "ext", "code", "comments", "blanks"
    )


def language_dist(changes: DataFrame, author: str, year: int, exts: Sequence[str]) -> DataFrame:
    """Number of repositories that changed files of each extension."""
    return (
        _of(changes, author, year)
        .filter(F.col("ext").isin(list(exts)))
        .select("repo_name", "ext")
        .distinct()
        .groupBy("ext")
        .agg(_rows().alias("count"))
        .orderBy(F.col("count").desc(), "ext")
    )


def period_dist(commits: DataFrame, author: str, year: int) -> DataFrame:
    mine = _of(commits, author, year)
    return mine.groupBy(fields.period(mine).alias("period")).agg(_rows().alias("count"))


def count_filtered(
    commits: DataFrame, author: str, year: int, repo: str, months: Sequence[int]
) -> DataFrame:
    return _of(commits, author, year, repo=repo, months=months).agg(_rows().alias("count"))


def churn_of_repo(
    changes: DataFrame, author: str, year: int, repo: str, months: Sequence[int]
) -> DataFrame:
    return (
        _of(changes, author, year, repo=repo, months=months)
        .filter(F.col("ext") != "")
        .groupBy("ext")
        .agg(F.sum("insertion").alias("insertion"), F.sum("deletion").alias("deletion"))
        .orderBy(F.col("insertion").desc(), "ext")
    )


def commits_by_weekday(commits: DataFrame, author: str, year: int) -> DataFrame:
    """Commits per weekday, Monday first."""
    mine = _of(commits, author, year)
    return (
        mine.groupBy(fields.weeknum(mine).alias("weeknum"))
        .agg(_rows().alias("count"))
        .orderBy("weeknum")
        .select(timefn.weekday_name(F.col("weeknum")).alias("week"), "count")
    )


def hours_filled(commits: DataFrame, author: str, year: int, weekend: bool) -> DataFrame:
    """Commits per hour on working days or at weekends, every hour seen anywhere included.

    One conditional count over the whole table instead of a union with an hour list.
    """
    free = fields.weeknum(commits).isin(5, 6)
    wanted = (
        (F.col("author_name") == author)
        & (fields.year(commits) == year)
        & (free if weekend else ~free)
    )
    return (
        commits.groupBy(fields.hour(commits).alias("hour"))
        .agg(F.count_if(wanted).alias("count"))
        .orderBy("hour")
    )


def commits_by_month(commits: DataFrame, author: str, year: int) -> DataFrame:
    mine = _of(commits, author, year)
    return (
        mine.groupBy(fields.month(mine).alias("month")).agg(_rows().alias("count")).orderBy("month")
    )


def popularity_total(active: DataFrame) -> DataFrame:
    return active.agg(F.sum("stars").alias("stars"), F.sum("forks").alias("forks"))


def contributors(commits: DataFrame, author: str) -> DataFrame:
    """How many people other than the author committed."""
    return commits.filter(F.col("author_name") != author).agg(
        F.count_distinct("author_name").alias("contributors")
    )


def timezones(commits: DataFrame) -> DataFrame:
    return commits.select(fields.timezone(commits).alias("timezone")).distinct().orderBy("timezone")


def domains(commits: DataFrame) -> DataFrame:
    return commits.select(F.col("author_domain").alias("domain")).distinct().orderBy("domain")


def top_starred(active: DataFrame, commits: DataFrame, author: str, k: int = 10) -> DataFrame:
    """Most starred repositories of an author with the author's last commit."""
    mine = _of(commits, author)
    last = mine.groupBy("repo_name").agg(F.max(fields.seconds(mine)).alias("last_at"))
    return (
        active.join(last, "repo_name")
        .orderBy(F.col("stars").desc(), "repo_name")
        .limit(k)
        .select("repo_name", "stars", timefn.timestamp_rfc3339("last_at").alias("last_commit"))
    )


def repo_year_tz(commits: DataFrame) -> DataFrame:
    return commits.select(
        "repo_name", fields.year(commits).alias("year"), fields.timezone(commits).alias("tz")
    )


def max_insertion(changes: DataFrame) -> DataFrame:
    """Extension with the largest number of lines inserted by one commit."""
    return (
        changes.groupBy("ext")
        .agg(F.max("insertion").alias("insertion"))
        .orderBy(F.col("insertion").desc(), "ext")
        .limit(1)
    )


def tags_until(tags: DataFrame, until: int) -> DataFrame:
    return _of(tags, until=until).select("repo_name", "branch", "datetime", "tag")


def active_of(active: DataFrame, repo: str) -> DataFrame:
    return active.filter(F.col("repo_name") == repo)


def first_active(active: DataFrame, n: int = 5) -> DataFrame:
    return active.select("repo_name", "stars").orderBy("repo_name").limit(n)
