"""Commit-log sections to commits and changes.

A section is one text record: a header line and the change lines of that commit. All work
is local to the record, so parsing needs no shuffle and the churn per extension is summed
before its own; a repository of any size is spread over as many tasks as its log has input
splits.
"""

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist import schemas
from annalist.functions import fields, timefn

# The line shapes, month names and path shapes of the exported text.
HEADER = r"(?d)<(.*?)> <(.*)> <(.*)> <(.*?)>"
# A header without other angle brackets, which is its own match; found without backtracking.
PLAIN_HEADER = r"^<[^<>]*+> <[^<>]*+> <[^<>]*+> <[^<>]*+>\z"
CHANGE = r"(?d)([0-9-]+)\t([0-9-]+)\t(.*)"
MAIL_DATE = (
    r"^([A-Za-z]{3}, )?\d{1,2} [A-Za-z]{3} \d{4} "
    r"([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60) [+-]([01]\d|2[0-3])[0-5]\d\z"
)
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
EXTENSION = r"(?s)^(?:.*/)?[^/]+\.([^./]*)/*\z"
CLOSED_EXTENSION = r"(?s)^(?:.*/)?[^/]+\.([^./]*?)[^A-Za-z0-9./]?/*\z"


def mail_date_to_rfc3339(c: "Column | str") -> Column:
    """RFC 2822 date to RFC 3339 text with the same offset; ``''`` if it is not one.

    A weekday in front is optional, but must be the right one. The parts are cut at fixed
    places from the end, where only the day of the month varies in width.
    """
    c = F.col(c) if isinstance(c, str) else c
    month_at = F.instr(F.lit(MONTHS), F.lower(F.substring(c, -23, 3)))
    date = F.concat(
        F.substring(c, -19, 4),
        F.lit("-"),
        F.lpad(F.call_function("div", month_at + 2, F.lit(3)).cast("string"), 2, "0"),
        F.lit("-"),
        F.lpad(F.ltrim(F.substring(c, -26, 2)), 2, "0"),
    )
    offset = F.concat(F.substring(c, -5, 3), F.lit(":"), F.substring(c, -2, 2))
    text = F.concat(
        date,
        F.lit("T"),
        F.substring(c, -14, 8),
        F.when(offset == "-00:00", "+00:00").otherwise(offset),
    )
    named = F.when(c.contains(","), F.initcap(F.substring(c, 1, 3))).otherwise(timefn.WEEKDAYS)
    right_day = F.instr(named, timefn.weekday_name(F.weekday(date.try_cast("date")))) > 0
    return F.when(c.rlike(MAIL_DATE) & (month_at % 3 == 1) & right_day, text).otherwise("")


def email_domain(c: "Column | str") -> Column:
    """Text after the first ``@``; all of it if there is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.element_at(F.split(c, "@", 2), -1)


def file_ext(path: "Column | str") -> Column:
    """Extension of the last path part: ``''`` for dot files and names without a dot.

    One trailing character that is no letter or digit is removed from an ASCII extension,
    such as the brace of ``{a.c => b.rs}`` or the quote of a quoted path.
    """
    path = F.col(path) if isinstance(path, str) else path
    raw = F.regexp_extract(path, EXTENSION, 1)
    is_ascii = F.octet_length(path) == F.length(path)
    return F.when(
        is_ascii | (F.octet_length(raw) == F.length(raw)),
        F.regexp_extract(path, CLOSED_EXTENSION, 1),
    ).otherwise(raw)


def _count(text: Column) -> Column:
    """Line counter; ``-`` of a binary file and anything else that is no number is 0."""
    return F.greatest(F.coalesce(text.try_cast("bigint"), F.lit(0)), F.lit(0)).cast("bigint")


def matched_header(line: Column) -> Column:
    """What ``HEADER`` matches in one line; ``''`` if it does not."""
    return F.when(line.rlike(PLAIN_HEADER), line).otherwise(F.regexp_extract(line, HEADER, 0))


def parse_sections(sections: DataFrame) -> DataFrame:
    """One row per section with its header fields, change list and verdict.

    Adds ``raw_date``, ``hash``, ``author_name``, ``author_email``, ``entries`` (one struct
    of ``ext, insertion, deletion`` per change line), ``bad_header`` and ``bad_change``. Other
    columns pass through; the text itself is dropped.
    """
    keep = [c for c in sections.columns if c != "value"]
    text = F.when(F.col("value").startswith("<"), F.col("value")).otherwise(
        F.concat(F.lit("<"), F.col("value"))
    )
    lines = F.filter(F.split(text, "\n"), lambda line: line != "")
    cut = sections.select(*keep, lines.alias("__lines")).select(
        *keep,
        matched_header(F.get("__lines", F.lit(0))).alias("__head"),
        F.transform(
            F.slice("__lines", F.lit(2), F.size("__lines")),
            lambda line: F.regexp_extract(line, CHANGE, 0),
        ).alias("__changes"),
    )
    # The header fields are what stands between the separators of the match; a separator
    # inside a field counts to the hash, as with a greedy match.
    part = F.split(F.expr("substring(__head, 2, length(__head) - 2)"), "> <")
    split = cut.select(
        *keep,
        part.alias("__part"),
        F.transform("__changes", lambda line: F.split(line, "\t", 3)).alias("__fields"),
        (F.col("__head") == "").alias("bad_header"),
        F.array_contains("__changes", "").alias("bad_change"),
    )
    return split.select(
        *keep,
        F.get("__part", F.lit(0)).alias("raw_date"),
        F.array_join(
            F.slice("__part", F.lit(2), F.greatest(F.size("__part") - 3, F.lit(0))), "> <"
        ).alias("hash"),
        F.try_element_at("__part", F.lit(-2)).alias("author_name"),
        F.try_element_at("__part", F.lit(-1)).alias("author_email"),
        F.transform(
            "__fields",
            lambda f: F.struct(
                file_ext(F.get(f, F.lit(2))).alias("ext"),
                _count(F.get(f, F.lit(0))).alias("insertion"),
                _count(F.get(f, F.lit(1))).alias("deletion"),
            ),
        ).alias("entries"),
        "bad_header",
        "bad_change",
    )


def author_rules(spark: SparkSession, rules: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """A mapping from ``(source name, source mail, new name, new mail)`` rules, in order.

    Made from Arrow data, so the planner knows how small it is.
    """
    names = schemas.columns(schemas.AUTHOR_MAPPING)
    columns = [pa.array(range(len(rules)), pa.int32())]
    columns += [pa.array([rule[i] for rule in rules], pa.string()) for i in range(4)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=names))


def map_authors(commits: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace authors whose name and email both match a mapping; the first mapping wins.

    Applied once, without chaining. The join strategy is left to Spark, which broadcasts the
    mapping only while its size allows.
    """
    first = mapping.groupBy("src_name", "src_email").agg(
        F.min_by(F.struct("dst_name", "dst_email"), "ord").alias("__dst")
    )
    same = (F.col("author_name") == F.col("src_name")) & (
        F.col("author_email") == F.col("src_email")
    )
    return (
        commits.join(first, same, "left")
        .withColumns(
            {
                "author_name": F.coalesce("__dst.dst_name", "author_name"),
                "author_email": F.coalesce("__dst.dst_email", "author_email"),
            }
        )
        .drop("src_name", "src_email", "__dst")
    )


def change_fields(line: "Column | str") -> Column:
    """A change line as ``ext, insertion, deletion``; the fields of any other line are NULL."""
    match = F.regexp_extract(line, CHANGE, 0)
    part = F.split(match, "\t", 3)
    good = match != ""
    return F.struct(
        F.when(good, file_ext(F.get(part, F.lit(2)))).alias("ext"),
        F.when(good, _count(F.get(part, F.lit(0)))).alias("insertion"),
        F.when(good, _count(F.get(part, F.lit(1)))).alias("deletion"),
    )


def finish(parsed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Derived commit columns, the time fields, the change lines, and ``reject``.

    ``reject`` is NULL for a good section, else ``header`` or ``change``: one bad line drops
    its whole commit. ``section`` numbers the rows, unless it is among the columns to ``keep``.
    """
    done = parsed.select(
        "repo_name",
        "hash",
        F.coalesce("branch", F.lit("")).alias("branch"),
        mail_date_to_rfc3339("raw_date").alias("datetime"),
        "author_name",
        "author_email",
        email_domain("author_email").alias("author_domain"),
        F.size("entries").cast("bigint").alias("files"),
        "entries",
        F.when(F.col("bad_header"), "header").when(F.col("bad_change"), "change").alias("reject"),
        *keep,
    )
    done = fields.enrich(done)
    return done if "section" in keep else done.withColumn("section", F.monotonically_increasing_id())


def accepted(finished: DataFrame) -> DataFrame:
    return finished.filter(F.col("reject").isNull())


def reject_counts(finished: DataFrame) -> DataFrame:
    """Dropped sections per repository and reason."""
    return (
        finished.filter(F.col("reject").isNotNull())
        .groupBy("repo_name", "reject")
        .agg(F.count(F.lit(1)).alias("sections"))
    )


_TIME = [field.name for field in schemas.PARSED_TIME]


def commits(finished: DataFrame) -> DataFrame:
    """The ``commit`` table, with the time fields it is stored with."""
    return finished.select(*schemas.columns(schemas.COMMIT), *_TIME)


def changes(finished: DataFrame) -> DataFrame:
    """The ``change`` table: one row per commit and extension, none for an empty commit.

    A section is one row, so its change lines are summed by extension inside that row, without a
    shuffle, while it has ``_MOST_IN_ROW`` extensions at most. Sections with more of them are
    summed by section and extension, so that a commit with any number of extensions costs no more
    than its lines. ``section`` tells apart the rows of a repository that is listed twice, so use
    it on a staged table, where the numbers stand still.
    """
    commit = [*schemas.columns(schemas.COMMIT), *_TIME]
    # A section has no more extensions than lines; only where it has more lines are they looked at.
    short = F.size("entries") <= _MOST_IN_ROW
    few = F.when(short, True).otherwise(F.size(_extensions()) <= _MOST_IN_ROW)
    in_row = finished.filter(few).select(*commit, F.inline(_churn()))
    lines = finished.filter(~few).select("section", *commit, F.inline("entries"))
    sums = lines.groupBy("section", *commit, "ext").agg(
        F.sum("insertion").alias("insertion"), F.sum("deletion").alias("deletion")
    )
    names = [*schemas.columns(schemas.CHANGE), *_TIME]
    return in_row.select(*names).unionByName(sums.select(*names))


#: Extensions of a section that are summed inside its row; each is one more look at its lines.
_MOST_IN_ROW = 32


def _extensions() -> Column:
    return F.array_distinct(F.transform("entries", lambda e: e["ext"]))


def _churn() -> Column:
    """``ext, insertion, deletion`` for each extension of ``entries``."""

    def total(own: Column, name: str) -> Column:
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda sum_, e: sum_ + e[name])

    # The lines of each extension are picked once for both sums; no line is NULL.
    groups = F.transform(_extensions(), lambda x: F.filter("entries", lambda e: e["ext"].eqNullSafe(x)))
    return F.transform(
        groups,
        lambda own: F.struct(
            own[0]["ext"].alias("ext"), total(own, "insertion").alias("insertion"), total(own, "deletion").alias("deletion")
        ),
    )


def file_counts(finished: DataFrame) -> DataFrame:
    """Changed files per commit."""
    return finished.select("repo_name", "hash", "files")
