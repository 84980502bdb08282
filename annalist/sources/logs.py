"""Exported history text: commit logs, tag lists and source trees.

A repository's files lie under ``repo_name=<name>/``, with ``/`` in the name escaped as
``%2F``, so the name is a partition column and any number of files per repository works.

The commit log of a repository is the output of::

    git log --no-merges --date=rfc --pretty=format:'<%ad> <%H> <%aN> <%aE>' --numstat HEAD

and its list of references, with the commit that dates each one, is the output of::

    git show-ref --head --tags -d | while read hash ref; do
        printf '%s %s\t' "$hash" "$ref"
        git log --no-merges -n 1 --date=rfc --pretty=format:'<%ad> <%H> <%aN> <%aE>' "$hash"
        echo
    done

Lines without the part behind the tab, as ``git show-ref`` prints them, are read as well. What
leads from a merge to other commits is the output of::

    git log --all --format='%H %ct %P'
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what stands before a tag name.
TAG_PREFIX = "refs/tags/"
# Fixed value: what marks the second line of an annotated tag.
PEELED = "^{}"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per commit section: ``value, repo_name``.

    A record ends where a line starts with ``<``. The files stay splittable, so a large
    repository is read by many tasks; one commit is one record.
    """
    return (
        spark.read.schema("value STRING, repo_name STRING").option("lineSep", "\n<").text(path)
    )


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line: ``repo_name, file, block, value``, in order within a block of a file.

    ``block`` is where the task's part of the file begins; a commit may lie over many blocks.
    """
    return (
        spark.read.schema("value STRING, repo_name STRING")
        .text(path)
        .select(
            "repo_name",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            "value",
        )
    )


def _read_references(spark: SparkSession, path: str) -> DataFrame:
    """``repo_name, hash, ref, header`` of each line with a blank; the header may be NULL."""
    part = F.split(F.substring_index("value", "\t", 1), " ", 2)
    header = F.when(F.instr("value", "\t") > 0, F.expr("substring(value, instr(value, '\t') + 1)"))
    return (
        spark.read.schema("value STRING, repo_name STRING")
        .text(path)
        .filter(F.size(part) == 2)
        .select(
            "repo_name",
            F.get(part, F.lit(0)).alias("hash"),
            F.get(part, F.lit(1)).alias("ref"),
            header.alias("header"),
        )
    )


def read_refs(spark: SparkSession, path: str) -> DataFrame:
    """Tags: ``repo_name, hash, tag, header``, one row per repository and tag.

    ``header`` is the line of the commit that dates the tag, if the export has it. An annotated
    tag is listed twice, the second time as ``tag^{}`` with the hash of what it points at; that
    hash is the tag's. Lines without a blank are skipped.
    """
    tagged = _read_references(spark, path).filter(F.col("ref").startswith(TAG_PREFIX))
    peeled = F.col("ref").endswith(PEELED)
    name = F.expr(f"substring(ref, {len(TAG_PREFIX) + 1})")
    found = tagged.select(
        "repo_name",
        "hash",
        F.when(peeled, F.expr(f"left(substring(ref, {len(TAG_PREFIX) + 1}), length(ref) - {len(TAG_PREFIX) + len(PEELED)})"))
        .otherwise(name)
        .alias("tag"),
        "header",
        peeled.alias("__peeled"),
    )
    best = F.max_by(F.struct("hash", "header"), F.struct("__peeled", "hash")).alias("__best")
    return (
        found.groupBy("repo_name", "tag")
        .agg(best)
        .select("repo_name", "__best.hash", "tag", "__best.header")
    )


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """``repo_name, header`` of the line for HEAD, where the export of references has one."""
    lines = _read_references(spark, path).filter((F.col("ref") == "HEAD") & F.col("header").isNotNull())
    return lines.groupBy("repo_name").agg(F.max("header").alias("header"))


def read_parents(spark: SparkSession, path: str) -> DataFrame:
    """``repo_name, hash, seconds, parents`` of each commit, merges included.

    Lines without a hash and a time are skipped.
    """
    part = F.split("value", " ")
    found = (
        spark.read.schema("value STRING, repo_name STRING")
        .text(path)
        .select(
            "repo_name",
            F.get(part, F.lit(0)).alias("hash"),
            F.get(part, F.lit(1)).try_cast("bigint").alias("seconds"),
            F.filter(F.slice(part, 3, F.greatest(F.size(part) - 2, F.lit(0))), lambda x: x != "").alias("parents"),
        )
    )
    return found.filter((F.col("hash") != "") & F.col("seconds").isNotNull())


def read_source_records(spark: SparkSession, path: str) -> DataFrame:
    """Source files exported as JSON lines of ``repo_name, path, text``.

    Many small files in few large ones: the form to prefer for large trees.
    """
    return spark.read.schema("repo_name STRING, path STRING, text STRING").json(path)
