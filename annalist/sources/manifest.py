"""Repository lists: inline, from files, from saved API pages; exclusion; counters."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist import schemas


def read_manifests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Repository list files, one JSON object per line."""
    return spark.read.schema(schemas.MANIFEST).json(list(paths))


def combine(inline: "DataFrame | None", files: "DataFrame | None") -> DataFrame:
    """Inline list and file lists together; a repository in both stays there twice."""
    if inline is None or files is None:
        return inline if files is None else files
    return inline.unionByName(files)


def read_api_pages(spark: SparkSession, path: str, clone_dir: str) -> DataFrame:
    """Saved API responses, each file a JSON array of repositories, as a manifest."""
    pages = spark.read.schema(schemas.API_REPOSITORY).json(path, multiLine=True)
    below = clone_dir if clone_dir.endswith("/") or not clone_dir else f"{clone_dir}/"
    return pages.select(
        F.col("full_name").alias("name"),
        F.col("default_branch").alias("branch"),
        F.col("clone_url").alias("remote"),
        F.concat(F.lit(below), "full_name").alias("path"),
        "forks_count",
        "stargazers_count",
    )


def exclude_prefixes(manifest: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Drop repositories whose name starts with a prefix; ``foo`` also drops ``foobar/x``.

    The prefixes are grouped by length and each length is one set lookup, so a long list
    costs a row no more than a short one, and no join is needed.
    """
    by_length: dict[int, list[str]] = {}
    for prefix in prefixes:
        by_length.setdefault(len(prefix), []).append(prefix)
    kept = manifest
    for length, same_length in sorted(by_length.items()):
        kept = kept.filter(~F.substring("name", 1, length).isin(same_length))
    return kept


def exclude_prefix_table(manifest: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``exclude_prefixes`` with the prefixes in a table, column ``prefix``, of any length.

    A name is cut at each length that some prefix has, and the cuts meet the prefixes by
    equality; nothing is compared with all prefixes. Spark sends the shorter side to the longer
    one while it is small, and shuffles both by the cut beyond. The empty prefix drops all names;
    a NULL prefix none, and a NULL name stays.
    """
    listed = prefixes.select(F.col("prefix").alias("__cut")).filter("__cut IS NOT NULL").distinct()
    lengths = listed.agg(F.array_sort(F.collect_set(F.length("__cut"))).alias("n")).select("n").scalar()
    names = manifest.select("name").distinct().withColumn("__n", F.explode(lengths))
    cuts = names.filter(F.col("__n") <= F.length("name")).select("name", F.expr("left(name, __n)").alias("__cut"))
    dropped = cuts.join(listed, "__cut", "left_semi").select("name").distinct()
    return manifest.join(dropped, "name", "left_anti")


def active(manifest: DataFrame) -> DataFrame:
    """The ``active`` table: popularity counters, 0 where missing."""
    return manifest.select(
        F.col("name").alias("repo_name"),
        F.coalesce("forks_count", F.lit(0)).cast("bigint").alias("forks"),
        F.coalesce("stargazers_count", F.lit(0)).cast("bigint").alias("stars"),
    )


def with_branch(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add the scanned branch; only listed repositories stay, as often as they are listed."""
    listed = manifest.select(
        F.col("name").alias("repo_name"), F.coalesce("branch", F.lit("")).alias("branch")
    )
    return df.join(listed, "repo_name")
