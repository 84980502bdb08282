"""Dates for tags and repository heads."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import fields, timefn
from annalist.operators import ancestors, sections
from annalist.sources import manifest as manifests


def header_date(header: "Column | str") -> Column:
    """The date of a commit's header line as it stands there; NULL if it is no header line."""
    found = F.regexp_extract(header, sections.HEADER, 0)
    return F.when(found != "", F.regexp_extract(header, sections.HEADER, 1))


def header_datetime(header: "Column | str") -> Column:
    """The date of a commit's header line as RFC 3339 text; NULL if it is no header line."""
    date = header_date(header)
    return F.when(date.isNotNull(), sections.mail_date_to_rfc3339(date))


def with_dates(refs: DataFrame) -> DataFrame:
    """``repo_name, hash, tag, date`` of references, with the ``header_date`` of each.

    Apart from what becomes of the date, which looks at it many times, so that a header is
    searched once; stored, it is not searched again for the filters on it either.
    """
    header = F.col("header") if "header" in refs.columns else F.lit(None).cast("string")
    return refs.select("repo_name", "hash", "tag", header_date(header).alias("date"))


def dated(refs: DataFrame, commits: DataFrame, parents: "DataFrame | None" = None) -> DataFrame:
    """``repo_name, tag, datetime`` of every tag; the date is NULL where nothing gives it.

    The header line of the reference dates the tag, so a tag on a side branch or on a merge is
    dated like any other. A reference without that line looks its hash up among the commits; with
    ``parents`` (see ``logs.read_parents``) a merge is first led to the newest commit that is none.

    Of the commits only those that some reference asks for go on: a semi join, for which Spark
    sends the references to the commits while they are few. ``refs`` may come from ``with_dates``.
    """
    own = refs if "date" in refs.columns else with_dates(refs)
    plain = own.filter(F.col("date").isNull()).drop("date")
    if parents is not None:
        led = ancestors.first_non_merges(parents).withColumn("__merge", F.lit(True))
        target = F.when(F.col("__merge"), F.col("found")).otherwise(F.col("hash"))
        plain = plain.join(led, ["repo_name", "hash"], "left").select("repo_name", target.alias("hash"), "tag")
    asked = plain.select("repo_name", "hash").distinct()
    known = commits.select("repo_name", "hash", F.col("datetime").alias("__found"))
    known = known.join(asked, ["repo_name", "hash"], "left_semi").dropDuplicates(["repo_name", "hash"])
    looked_up = plain.join(known, ["repo_name", "hash"], "left")
    # Such a text is never NULL.
    own_date = sections.mail_date_to_rfc3339("date").alias("datetime")
    done = own.filter(F.col("date").isNotNull()).select("repo_name", "tag", own_date)
    return done.unionByName(looked_up.select("repo_name", "tag", F.col("__found").alias("datetime")))


def tags(
    refs: DataFrame, commits: DataFrame, manifest: DataFrame, parents: "DataFrame | None" = None
) -> DataFrame:
    """The ``tag`` table: each dated reference; ``tag_rejects`` counts the others."""
    return tag_rows(dated(refs, commits, parents), manifest)


def tag_rejects(refs: DataFrame, commits: DataFrame, parents: "DataFrame | None" = None) -> DataFrame:
    """Tags per repository that neither a header line nor a known commit dates."""
    return undated(dated(refs, commits, parents))


def tag_rows(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """The ``tag`` table from what ``dated`` gives."""
    once = found.filter(F.col("datetime").isNotNull()).dropDuplicates(["repo_name", "tag"])
    return manifests.with_branch(once, manifest).select("repo_name", "branch", "datetime", "tag")


def undated(found: DataFrame) -> DataFrame:
    """``repo_name, tags``: how many of what ``dated`` gives have no date."""
    return (
        found.filter(F.col("datetime").isNull())
        .groupBy("repo_name")
        .agg(F.count(F.lit(1)).alias("tags"))
    )


# A moment and its UTC offset packed in one number that sorts by moment, then offset. A
# number is a fixed-size aggregation buffer, which keeps max() in a hash aggregate; max_by()
# over text would sort the whole commit table first.
_OFFSETS = 4096
_OFFSET_ZERO = 2048


def _pack(df: DataFrame) -> Column:
    if "utc_ts" in df.columns:
        seconds = F.unix_seconds(df["utc_ts"])
        offset = timefn.offset_minutes(df["tz"])
    else:
        seconds = fields.seconds(df)
        offset = timefn.offset_minutes(df["datetime"])
    return seconds * _OFFSETS + offset + _OFFSET_ZERO


def _unpack(packed: Column) -> Column:
    offset = F.pmod(packed, F.lit(_OFFSETS)) - _OFFSET_ZERO
    seconds = F.call_function("div", packed - F.pmod(packed, F.lit(_OFFSETS)), F.lit(_OFFSETS))
    minutes = F.abs(offset)
    return F.concat(
        F.date_format(timefn.utc_clock(seconds + offset * 60), "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(offset < 0, "-").otherwise("+"),
        F.lpad(F.call_function("div", minutes, F.lit(60)).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((minutes % 60).cast("string"), 2, "0"),
    )


def heads(commits: DataFrame, lines: "DataFrame | None" = None) -> DataFrame:
    """``repo_name, datetime`` of the head commit of every repository.

    ``lines`` has ``repo_name, header`` with the header line of HEAD; author dates need not
    rise along a history, so this line decides. A repository without one takes its latest
    commit by author time.
    """
    latest = commits.groupBy("repo_name").agg(F.max(_pack(commits)).alias("__at"))
    latest = latest.select(
        "repo_name", F.coalesce(_unpack(F.col("__at")), F.lit("")).alias("datetime")
    )
    if lines is None:
        return latest
    named = lines.select("repo_name", header_datetime("header").alias("__head"))
    both = latest.join(named, "repo_name", "full")
    return both.select("repo_name", F.coalesce("__head", "datetime", F.lit("")).alias("datetime"))
