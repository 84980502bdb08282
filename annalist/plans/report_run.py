"""Run a report: named queries of one or more SQL statements, results kept as tables."""

import re
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from annalist.functions import sqlfn
from annalist.sources import shared

# Function names of the history dialect that would hide Spark's own, and the
# streak aggregates by their forms over a set of days.
_PREFIXED = ("year", "month", "weekday", "hour", "timestamp")
_STREAKS = {f"active_longest_{x}": f"streak_{x}" for x in ("days", "start", "end")}

_QUOTED = re.compile(r"('(?:[^'\\]|''|\\.)*'|\"[^\"]*\"|`[^`]*`)", re.S)
_TABLE = re.compile(r"(\b(?:from|join)\s+)(['\"])([A-Za-z_]\w*\.[A-Za-z_]\w*)\2", re.I)
_CALL = re.compile(rf"(?<![\w.])({'|'.join((*_PREFIXED, *_STREAKS))})\s*\(", re.I)


def spark_statement(text: str) -> str:
    """A statement in the history dialect as Spark SQL; anything else is left as it is.

    ``'db.table'`` behind FROM and JOIN becomes a table name; ``year``, ``month``, ``weekday``,
    ``hour`` and ``timestamp`` become the functions of RFC 3339 text; the streak aggregates
    ``active_longest_days``, ``_start`` and ``_end`` become functions of the group's set of days,
    which Spark collects with partial sets and the calendar bounds. Quoted text is not touched.
    """
    text = _TABLE.sub(r"\1\3", text.rstrip().rstrip(";"))
    at = 0
    while found := _CALL.search(text, at):
        at = found.end()
        if any(q.start() < found.start() < q.end() for q in _QUOTED.finditer(text)):
            continue
        name = found[1].lower()
        if name in _PREFIXED:
            call = f"rfc_{name}("
        else:
            close = _closing(text, at)
            call = f"{_STREAKS[name]}(collect_set(rfc_utc_day("
            text = f"{text[:close]})){text[close:]}"
        text = text[: found.start()] + call + text[at:]
        at = found.start() + len(call)
    return text


def _closing(text: str, at: int) -> int:
    """Where the bracket is closed that was opened before ``at``; quoted brackets do not count."""
    masked = _QUOTED.sub(lambda q: "_" * len(q[0]), text)
    depth = 1
    for place in range(at, len(masked)):
        depth += {"(": 1, ")": -1}.get(masked[place], 0)
        if not depth:
            return place
    raise ValueError(f"a bracket is not closed: {text}")


def _used_columns(columns: Sequence[str], statements: Sequence[str]) -> list[str]:
    """The columns that some statement may name: all of them where one selects all."""
    text = "\n".join(statements)
    if re.search(r"(?:\bselect|\bdistinct|,|\.)\s*\*", text, re.I):
        return list(columns)
    return [c for c in columns if re.search(rf"(?<!\w){re.escape(c)}(?!\w)", text, re.I)]


def _share(spark: SparkSession, table: str, statements: Sequence[str]) -> "tuple[str, str]":
    """Stage what the statements read of a table; the stage's path and the name it now has."""
    frame = spark.table(table)
    wanted = _used_columns(frame.columns, statements) or frame.columns[:1]
    path = shared.folder(spark, "report-stage")
    frame.select(*wanted).write.parquet(path)
    name = table.rpartition(".")[2]
    spark.read.schema(frame.select(*wanted).schema).parquet(path).createOrReplaceTempView(name)
    return path, name


def run_report(
    spark: SparkSession, queries: Mapping[str, Sequence[str]], out: str, share: Sequence[str] = ()
) -> dict[str, list[DataFrame]]:
    """Run the statements and write each result to ``out/<query>/<index>``.

    Returns the stored results by query name and statement index, ready for
    ``results.chart_series``; ``show()`` on one of them is the plain table output. Statements
    may be in the history dialect, see ``spark_statement``.

    Tables in ``share``, as ``db.table``, are scanned once: the columns that the report's
    statements name are staged in the shared folder, and the statements read the stage, several
    at a time. Leave a table out of ``share`` if the statements filter it to a few of its
    partitions each, since a stage has none.
    """
    texts = {name: [spark_statement(s) for s in statements] for name, statements in queries.items()}
    if not share:
        sqlfn.register(spark)
        return {
            name: [_store(spark, text, f"{out}/{name}/{i}") for i, text in enumerate(statements)]
            for name, statements in texts.items()
        }
    names = [t.rpartition(".")[2].lower() for t in share]
    if len(set(names)) < len(names):
        raise ValueError(f"shared tables of the same name: {sorted(share)}")
    # The views of the stages are seen by this report alone.
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    sqlfn.register(own)
    paths = []
    for table in share:
        reads = re.compile(rf"(?<![\w.`]){re.escape(table)}(?![\w`])", re.I)
        every = [s for statements in texts.values() for s in statements]
        path, name = _share(own, table, [s for s in every if reads.search(s)])
        paths.append(path)
        texts = {k: [reads.sub(name, s) for s in statements] for k, statements in texts.items()}
    with ThreadPoolExecutor(max_workers=4) as pool:
        run = inheritable_thread_target(own)(_store)
        started = {
            name: [pool.submit(run, own, text, f"{out}/{name}/{i}") for i, text in enumerate(statements)]
            for name, statements in texts.items()
        }
        for jobs in started.values():
            for job in jobs:
                job.result()
    for path in paths:
        shared.remove(spark, path)
    return {
        name: [spark.read.parquet(f"{out}/{name}/{i}") for i in range(len(jobs))] for name, jobs in started.items()
    }


def _store(spark: SparkSession, text: str, path: str) -> DataFrame:
    spark.sql(text).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
