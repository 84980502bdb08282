"""Commits and changes from single log lines, for commits too large to be one record.

The log is read line by line, so its files split anywhere, also inside a commit. Every task numbers
the headers of its block and sums its change lines per section and extension; what stands in front
of a block's first header belongs to the last header of the blocks before. These few rows a block,
not the lines, are shuffled, and a window over the blocks of a file tells each one what was open
when it began. No task holds a section: one of any size is some sums from each of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist import schemas
from annalist.operators import sections
from annalist.sources import manifest as manifests, shared, workers

_BLOCK = ("repo_name", "file", "block")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``part``: how many headers of its block a line has behind it or is itself."""
    last, count = None, 0
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        file, block, value = (batch.column(x) for x in ("file", "block", "value"))
        new = np.empty(rows, bool)
        new[0] = (file[0].as_py(), block[0].as_py()) != last
        for column in (file, block):
            other = pc.not_equal(column.slice(1), column.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
            new[1:] = other if column is file else new[1:] | other
        head = pc.starts_with(value, "<").to_numpy(zero_copy_only=False)
        total = np.cumsum(head)
        opens = np.flatnonzero(new)
        before = np.r_[-count, total[opens] - head[opens]]
        part = total - before[np.cumsum(new)]
        last, count = (file[rows - 1].as_py(), block[rows - 1].as_py()), int(part[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int64())], [*batch.schema.names, "part"])


def pieces(lines: DataFrame) -> DataFrame:
    """Sums of a block's lines: ``repo_name, file, block, part, header, ext, insertion, deletion, lines, bad``.

    ``lines`` has ``repo_name, file, block, value`` in the order of the file, as
    ``logs.read_log_lines`` gives it. A header is a row of its own.
    """
    workers.ship(lines.sparkSession)
    kept = lines.select(*_BLOCK, "value").filter("value <> ''")
    numbered = kept.mapInArrow(_numbered, "repo_name string, file string, block long, value string, part long")
    header = F.col("value").startswith("<")
    cut = numbered.select(
        *_BLOCK,
        "part",
        F.when(header, F.col("value")).alias("header"),
        F.when(~header, sections.change_fields("value")).alias("change"),
    )
    return cut.groupBy(*_BLOCK, "part", "header", F.col("change.ext").alias("ext")).agg(
        F.sum("change.insertion").alias("insertion"),
        F.sum("change.deletion").alias("deletion"),
        F.count("change").alias("lines"),
        F.count(F.when(F.col("change.ext").isNull(), F.col("change"))).alias("bad"),
    )


def joined(found: DataFrame) -> DataFrame:
    """Pieces with ``section``, the header they belong to, wherever it stands.

    Lines in front of the first header of a file have a section of their own, without a header.
    """
    blocks = found.groupBy(*_BLOCK).agg(F.max("part").alias("headers"))
    before = Window.partitionBy("repo_name", "file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.col("headers") > 0, F.struct(F.col("block").alias("b"), F.col("headers").alias("p")))
    opened = blocks.select(*_BLOCK, F.last(last, ignorenulls=True).over(before).alias("open"))
    own = found.filter("part > 0").withColumn("section", F.struct("file", F.col("block").alias("b"), F.col("part").alias("p")))
    none = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("p"))
    carried = found.filter("part = 0").join(opened, list(_BLOCK))
    at = F.coalesce("open", none)
    carried = carried.withColumn("section", F.struct("file", at["b"].alias("b"), at["p"].alias("p"))).drop("open")
    return own.unionByName(carried)


def parse(lines: DataFrame, manifest: DataFrame, mapping: "DataFrame | None" = None) -> "tuple[DataFrame, DataFrame]":
    """The staged sections and the ``change`` table of a log read by lines.

    The sections are what ``sections.finish`` gives, without entries, so ``sections.accepted``,
    ``commits``, ``file_counts`` and ``reject_counts`` take them. One bad line drops its commit.
    """
    spark = lines.sparkSession
    path = shared.folder(spark, "pieces")
    joined(_stored(pieces(lines), shared.folder(spark, "blocks"))).write.parquet(path)
    found = spark.read.parquet(path)
    heads = found.filter("header IS NOT NULL").select("repo_name", "section", F.col("header").alias("value"))
    counts = found.groupBy("repo_name", "section").agg(F.sum("lines").alias("lines"), F.sum("bad").alias("bad"))
    parsed = sections.parse_sections(heads).drop("bad_change")
    parsed = counts.join(parsed, ["repo_name", "section"], "left").withColumns(
        {
            "bad_header": F.coalesce("bad_header", F.lit(True)),
            "bad_change": F.col("bad") > 0,
            "entries": F.coalesce("entries", F.array().cast(parsed.schema["entries"].dataType)),
        }
    )
    parsed = manifests.with_branch(parsed, manifest)
    if mapping is not None:
        parsed = sections.map_authors(parsed, mapping)
    done = sections.finish(parsed, keep=["section", "lines"]).withColumn("files", F.col("lines"))
    done = _stored(done.drop("lines"), shared.folder(spark, "sections"))
    sums = found.filter("ext IS NOT NULL").groupBy("repo_name", "section", "ext").agg(
        F.sum("insertion").alias("insertion"), F.sum("deletion").alias("deletion")
    )
    commits = sections.accepted(done).drop("files", "entries", "reject")
    changes = commits.join(sums, ["repo_name", "section"])
    return done, changes.select(*schemas.columns(schemas.CHANGE), *[f.name for f in schemas.PARSED_TIME])


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
