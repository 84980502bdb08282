"""The relational operators the report queries rely on, one query each."""

from pyspark.sql import functions as F

from annalist.functions import timefn
from checks import views
from checks.registry import HOUR, MONTH, TIMEZONE, UNIX, WEEKNUM, YEAR, check, rfc3339

AUTHOR = "user7"


def _one(name, view, sql, run):
    @check(name, sql)
    def query(spark, sf_dir):
        return run(getattr(views, view)(spark, sf_dir))


def _count():
    return F.count(F.lit(1)).alias("count")


_one(
    "rel_project",
    "commits",
    f"SELECT repo_name AS repo, {YEAR} AS year, {TIMEZONE} AS tz FROM f_commit",
    lambda t: t.select(
        F.col("repo_name").alias("repo"),
        timefn.year("datetime").alias("year"),
        timefn.timezone("datetime").alias("tz"),
    ),
)
_one("rel_select_star", "tags", "SELECT * FROM f_tag", lambda t: t.select("*"))
_one(
    "rel_filter_cmp",
    "changes",
    f"""SELECT repo_name, hash, ext, insertion FROM f_change
        WHERE author_name = '{AUTHOR}' AND ext != '' AND insertion <= 20""",
    lambda t: t.filter(
        (F.col("author_name") == AUTHOR) & (F.col("ext") != "") & (F.col("insertion") <= 20)
    ).select("repo_name", "hash", "ext", "insertion"),
)
_one(
    "rel_filter_or",
    "commits",
    """SELECT hash FROM f_commit
       WHERE repo_name = 'AUTOMOBILE/NATION_7' OR repo_name = 'BUILDING/NATION_3'""",
    lambda t: t.filter(
        (F.col("repo_name") == "AUTOMOBILE/NATION_7") | (F.col("repo_name") == "BUILDING/NATION_3")
    ).select("hash"),
)
_one(
    "rel_in",
    "changes",
    "SELECT hash, ext FROM f_change WHERE ext IN ('py', 'go')",
    lambda t: t.filter(F.col("ext").isin("py", "go")).select("hash", "ext"),
)
_one(
    "rel_not_in",
    "commits",
    f"SELECT hash FROM f_commit WHERE {WEEKNUM} NOT IN (5, 6)",
    lambda t: t.filter(~timefn.weeknum("datetime").isin(5, 6)).select("hash"),
)
_one(
    "rel_filter_fn",
    "commits",
    f"SELECT hash, datetime FROM f_commit WHERE {YEAR} = 1998",
    lambda t: t.filter(timefn.year("datetime") == 1998).select("hash", "datetime"),
)
_one(
    "rel_filter_derived",
    "commits",
    """SELECT * FROM (SELECT author_name, count(*) AS count FROM f_commit GROUP BY 1)
       WHERE count > 300""",
    lambda t: t.groupBy("author_name").agg(_count()).filter(F.col("count") > 300),
)
_one(
    "rel_group_cols",
    "changes",
    """SELECT repo_name, ext, CAST(sum(insertion) AS BIGINT) AS insertion
       FROM f_change GROUP BY 1, 2""",
    lambda t: t.groupBy("repo_name", "ext").agg(F.sum("insertion").alias("insertion")),
)
_one(
    "rel_group_alias",
    "commits",
    f"SELECT {HOUR} AS local_hour, count(*) AS count FROM f_commit GROUP BY local_hour",
    lambda t: t.groupBy(timefn.hour("datetime").alias("local_hour")).agg(_count()),
)
_one(
    "rel_global_agg",
    "active",
    """SELECT CAST(sum(stars) AS BIGINT) AS stars, max(forks) AS most, count(*) AS repos
       FROM f_active""",
    lambda t: t.agg(
        F.sum("stars").alias("stars"),
        F.max("forks").alias("most"),
        F.count(F.lit(1)).alias("repos"),
    ),
)
_one(
    "rel_count",
    "changes",
    """SELECT author_domain, count(1) AS all_rows, count(NULLIF(ext, '')) AS with_ext
       FROM f_change GROUP BY 1""",
    lambda t: t.groupBy("author_domain").agg(
        F.count(F.lit(1)).alias("all_rows"), F.count(F.nullif("ext", F.lit(""))).alias("with_ext")
    ),
)
_one(
    "rel_count_distinct",
    "commits",
    "SELECT repo_name, count(DISTINCT author_name) AS people FROM f_commit GROUP BY 1",
    lambda t: t.groupBy("repo_name").agg(F.count_distinct("author_name").alias("people")),
)
_one(
    "rel_sum",
    "changes",
    """SELECT ext, CAST(sum(insertion) AS BIGINT) AS insertion,
              CAST(sum(deletion) AS BIGINT) AS deletion FROM f_change GROUP BY 1""",
    lambda t: t.groupBy("ext").agg(
        F.sum("insertion").alias("insertion"), F.sum("deletion").alias("deletion")
    ),
)
_one(
    "rel_min",
    "commits",
    f"SELECT repo_name, min({UNIX}) AS first_ts FROM f_commit GROUP BY 1",
    lambda t: t.groupBy("repo_name").agg(F.min(timefn.timestamp("datetime")).alias("first_ts")),
)
_one(
    "rel_max",
    "commits",
    f"SELECT repo_name, author_name, max({UNIX}) AS last_ts FROM f_commit GROUP BY 1, 2",
    lambda t: t.groupBy("repo_name", "author_name").agg(
        F.max(timefn.timestamp("datetime")).alias("last_ts")
    ),
)
_one(
    "rel_avg",
    "active",
    "SELECT avg(stars) AS stars, avg(forks) AS forks FROM f_active",
    lambda t: t.agg(F.avg("stars").alias("stars"), F.avg("forks").alias("forks")),
)
_one(
    "rel_fn_of_agg",
    "tags",
    f"SELECT repo_name, {rfc3339(f'min({UNIX})')} AS first_tag FROM f_tag GROUP BY 1",
    lambda t: t.groupBy("repo_name")
    .agg(F.min(timefn.timestamp("datetime")).alias("at"))
    .select("repo_name", timefn.timestamp_rfc3339("at").alias("first_tag")),
)
_one(
    "rel_ratio",
    "commits",
    """SELECT author_name, CAST(count(*) AS DOUBLE) / CAST(365 AS DOUBLE) AS per_day
       FROM f_commit GROUP BY 1""",
    lambda t: t.groupBy("author_name").agg((F.count(F.lit(1)) / F.lit(365.0)).alias("per_day")),
)
_one(
    "rel_nested_agg",
    "changes",
    """SELECT ext, count(ext) AS repos, CAST(max(insertion) AS BIGINT) AS largest
       FROM (SELECT repo_name, ext, sum(insertion) AS insertion FROM f_change GROUP BY 1, 2)
       GROUP BY 1""",
    lambda t: t.groupBy("repo_name", "ext")
    .agg(F.sum("insertion").alias("insertion"))
    .groupBy("ext")
    .agg(F.count("ext").alias("repos"), F.max("insertion").alias("largest")),
)
_one(
    "rel_order",
    "active",
    "SELECT repo_name, stars, forks FROM f_active ORDER BY forks, stars DESC",
    lambda t: t.select("repo_name", "stars", "forks").orderBy("forks", F.col("stars").desc()),
)
_one(
    "rel_topk",
    "active",
    "SELECT repo_name, stars FROM f_active ORDER BY stars DESC, repo_name LIMIT 10",
    lambda t: t.select("repo_name", "stars").orderBy(F.col("stars").desc(), "repo_name").limit(10),
)
_one(
    "rel_limit",
    "commits",
    "SELECT repo_name, hash FROM f_commit ORDER BY hash LIMIT 5",
    lambda t: t.select("repo_name", "hash").orderBy("hash").limit(5),
)
_one(
    "rel_distinct",
    "commits",
    f"SELECT DISTINCT author_domain, {TIMEZONE} AS tz FROM f_commit",
    lambda t: t.select("author_domain", timefn.timezone("datetime").alias("tz")).distinct(),
)


@check(
    "rel_union",
    f"""SELECT repo_name, {YEAR} AS active_year FROM f_commit
        UNION SELECT repo_name, {YEAR} FROM f_tag""",
)
def rel_union(spark, sf_dir):
    columns = ("repo_name", timefn.year("datetime").alias("active_year"))
    commits, tags = views.commits(spark, sf_dir), views.tags(spark, sf_dir)
    return commits.select(*columns).union(tags.select(*columns)).distinct()


@check(
    "rel_zero_fill",
    f"""SELECT repo_name, CAST(sum(count) AS BIGINT) AS count FROM (
          SELECT repo_name, 0 AS count FROM f_commit
          UNION SELECT repo_name, count(*) FROM f_commit
                WHERE author_name = '{AUTHOR}' AND {MONTH} = 2 GROUP BY 1) GROUP BY 1""",
)
def rel_zero_fill(spark, sf_dir):
    """The union of zero rows and counts, summed again."""
    commits = views.commits(spark, sf_dir)
    zeros = commits.select("repo_name", F.lit(0).cast("bigint").alias("count"))
    counts = (
        commits.filter((F.col("author_name") == AUTHOR) & (timefn.month("datetime") == 2))
        .groupBy("repo_name")
        .agg(_count())
    )
    return zeros.union(counts).distinct().groupBy("repo_name").agg(F.sum("count").alias("count"))


_LAST = f"SELECT repo_name, author_name, max({UNIX}) AS ts FROM f_commit GROUP BY 1, 2"


def _last(spark, sf_dir):
    return (
        views.commits(spark, sf_dir)
        .groupBy("repo_name", "author_name")
        .agg(F.max(timefn.timestamp("datetime")).alias("ts"))
    )


@check(
    "rel_left_join",
    f"""SELECT a.repo_name, stars, author_name, ts
        FROM f_active a LEFT JOIN (SELECT * FROM ({_LAST}) WHERE author_name = '{AUTHOR}') l
          ON a.repo_name = l.repo_name""",
)
def rel_left_join(spark, sf_dir):
    active = views.active(spark, sf_dir).select("repo_name", "stars")
    mine = _last(spark, sf_dir).filter(F.col("author_name") == AUTHOR)
    return active.join(mine, "repo_name", "left")


@check(
    "rel_left_join_filter",
    f"""SELECT a.repo_name, stars, ts FROM f_active a LEFT JOIN ({_LAST}) l
          ON a.repo_name = l.repo_name
        WHERE author_name = '{AUTHOR}'""",
)
def rel_left_join_filter(spark, sf_dir):
    """The filter on the optional side makes Catalyst plan an inner join."""
    active = views.active(spark, sf_dir).select("repo_name", "stars")
    joined = active.join(_last(spark, sf_dir), "repo_name", "left")
    return joined.filter(F.col("author_name") == AUTHOR).select("repo_name", "stars", "ts")
