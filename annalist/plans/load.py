"""Load: exported history text to the five stored tables."""

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist import schemas
from annalist.operators import linecount, sections, tags
from annalist.sources import logs, manifest as manifests, shared, tables


def stage(
    spark: SparkSession,
    path: str,
    manifest: DataFrame,
    log_path: str,
    mapping: "DataFrame | None" = None,
) -> DataFrame:
    """Parse the log into a columnar table at ``path`` and return that table.

    Without it every table would parse the log again, and Catalyst would push the filter on
    good sections below the parsing, which then runs once in the filter and once after it.
    """
    parsed = manifests.with_branch(
        sections.parse_sections(logs.read_log(spark, log_path)), manifest
    )
    if mapping is not None:
        parsed = sections.map_authors(parsed, mapping)
    sections.finish(parsed).write.mode("overwrite").parquet(path)
    return spark.read.schema(schemas.PARSED).parquet(path)


def _stored(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(
    spark: SparkSession,
    out: str,
    manifest: DataFrame,
    log_path: str,
    refs_path: "str | None" = None,
    sources: "DataFrame | None" = None,
    mapping: "DataFrame | None" = None,
    languages: Sequence[tuple] = linecount.LANGUAGES,
    other_prefixes: "Sequence[str] | None" = None,
    parents_path: "str | None" = None,
) -> DataFrame:
    """Replace the five tables below ``out``; return the rejects per repository and reason.

    The log is parsed once, into a staged columnar table in the shared folder; commits,
    changes and rejects are cheap column reads of it, and a lost executor costs a re-read
    of the stage, not of the log. Tables that do not need each other are written by
    concurrent jobs, so that the last tasks of one leave no executor idle. A table without
    input is written empty, so that nothing of an earlier load stays. The stage is deleted
    when the tables stand; the returned counts (``reject`` is ``header``, ``change`` or
    ``tag``) are stored in the shared folder. With ``parents_path`` tags on merges are dated by
    the newest commit behind them that is none, where their reference has no header line.
    """
    place, refs_place, tags_place = (shared.folder(spark, x) for x in ("parsed", "refs", "tags"))
    staged = stage(spark, place, manifest, log_path, mapping)
    finished = sections.accepted(staged)

    with ThreadPoolExecutor(max_workers=4) as pool:

        def start(name, table):
            write = inheritable_thread_target(spark)(tables.write_table)
            return pool.submit(write, name, table, out)

        running = [
            start("change", sections.changes(finished)),
            start("active", manifests.active(manifest)),
        ]
        tables.write_table("commit", sections.commits(finished), out)
        commits = tables.read_table(spark, "commit", out)
        rejects, lines = sections.reject_counts(staged), None
        tag, snapshot = (spark.createDataFrame([], schemas.TABLES[x]) for x in ("tag", "snapshot"))
        if refs_path is not None:
            # Stored first, so that their size is known before the commits are looked up.
            refs = _stored(spark, tags.with_dates(logs.read_refs(spark, refs_path)), refs_place)
            lines = logs.read_heads(spark, refs_path)
            parents = logs.read_parents(spark, parents_path) if parents_path is not None else None
            found = _stored(spark, tags.dated(refs, commits, parents), tags_place)
            tag = tags.tag_rows(found, manifest)
            rejects = rejects.union(tags.undated(found).select("repo_name", F.lit("tag"), "tags"))
        running.append(start("tag", tag))
        if sources is not None:
            counts = linecount.count_lines(sources, languages, other_prefixes)
            snapshot = linecount.snapshot(counts, tags.heads(commits, lines), manifest)
        running.append(start("snapshot", snapshot))
        kept = shared.folder(spark, "rejects")
        rejects.write.parquet(kept)
        for table in running:
            table.result()
    for used in (place, refs_place, tags_place):
        shared.remove(spark, used)
    return spark.read.schema(rejects.schema).parquet(kept)
