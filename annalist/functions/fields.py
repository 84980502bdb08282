"""Time fields of a history table, from stored columns where the table has them.

Loaded tables carry ``local_ts``, ``utc_ts``, ``tz`` and the partition column
``commit_year``; reading those skips the text parsing and lets a year filter prune
partitions. Any other DataFrame with a ``datetime`` text column works too.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import timefn


def enrich(df: DataFrame) -> DataFrame:
    """Add the parsed columns a stored table carries beside its ``datetime`` text.

    The text is parsed once, in a projection of its own; the rest derives from the result.
    """
    parsed = df.withColumn("local_ts", timefn.local_ts("datetime"))
    local = F.col("local_ts")
    return parsed.withColumns(
        {
            "utc_ts": F.timestamp_seconds(timefn.seconds_of(local, "datetime")),
            "tz": F.when(local.isNotNull(), timefn.offset_text("datetime")),
            "commit_year": F.year(local),
        }
    )


def _stored(df, name, otherwise):
    return df[name] if name in df.columns else otherwise(df["datetime"])


def local(df: DataFrame) -> Column:
    return _stored(df, "local_ts", timefn.local_ts)


def year(df: DataFrame) -> Column:
    return _stored(df, "commit_year", timefn.year)


def month(df: DataFrame) -> Column:
    return F.month(local(df))


def hour(df: DataFrame) -> Column:
    return F.hour(local(df))


def weeknum(df: DataFrame) -> Column:
    return F.weekday(local(df))


def weekday(df: DataFrame) -> Column:
    return timefn.weekday_name(weeknum(df))


def dateday(df: DataFrame) -> Column:
    return local(df).cast("date").cast("string")


def period(df: DataFrame) -> Column:
    return timefn.period_of_hour(hour(df))


def timezone(df: DataFrame) -> Column:
    return _stored(df, "tz", timefn.timezone)


def seconds(df: DataFrame) -> Column:
    if "utc_ts" in df.columns:
        return F.unix_seconds(df["utc_ts"])
    return timefn.timestamp(df["datetime"])
