"""Longest run of consecutive active days."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import fields
from annalist.functions.timefn import DAY


# More days than lie between the years 1 and 9999, on both sides of 1970.
_SPAN = 1 << 23
_OFF = 1 << 3


def longest_streak(df: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Longest run of consecutive UTC days per group, the earliest one on a tie.

    Gives ``active_longest_days``, ``active_longest_start`` and ``active_longest_end``.
    Unparseable times are skipped; a group without any, and a global run over nothing, gives
    0 days from 1970-01-01 to 1970-01-01.

    Events are first reduced to one row per group and day, with partial aggregation before
    the shuffle, so the window that follows sees at most the calendar days of a group however
    many events one group holds.
    """
    groups = list(group_cols)
    events = df.select(*groups, fields.seconds(df).alias("__ts"))
    days = (
        events.withColumn("__day", F.call_function("div", F.col("__ts"), F.lit(DAY)))
        .groupBy(*groups, "__day")
        .agg(F.min("__ts").alias("__first"), F.max("__ts").alias("__last"))
    )
    in_order = Window.partitionBy(*groups).orderBy(F.col("__day").asc_nulls_first())
    runs = (
        days.withColumn("__run", F.col("__day") - F.row_number().over(in_order))
        .groupBy(*groups, "__run")
        .agg(
            F.count("__day").alias("__days"),
            F.min("__first").alias("__first"),
            F.max("__last").alias("__last"),
        )
    )
    # The longest run, then the earliest, as one number: it is a fixed-size buffer, which keeps
    # the last step a hash aggregation. The last three bits say how far the end lies from where
    # start and length put it, which is only possible around 1970.
    start, end = (F.floor(F.col(c) / DAY) for c in ("__first", "__last"))
    off = end - start - F.col("__days") + 1 + _OFF // 2
    packed = (F.col("__days") * _SPAN - start + _SPAN // 2) * _OFF + off
    best = runs.groupBy(*groups).agg(F.max(F.when(F.col("__days") > 0, packed)).alias("__best"))
    rest = F.shiftright("__best", 3)
    days_in = F.shiftright("__best", 26)
    start = _SPAN // 2 - rest.bitwiseAND(F.lit(_SPAN - 1))
    end = start + days_in - 1 + F.col("__best").bitwiseAND(F.lit(_OFF - 1)) - _OFF // 2

    def date_text(day):
        return F.date_from_unix_date(F.coalesce(day, F.lit(0)).cast("int")).cast("string")

    return best.select(
        *groups,
        F.coalesce(days_in, F.lit(0)).cast("bigint").alias("active_longest_days"),
        date_text(start).alias("active_longest_start"),
        date_text(end).alias("active_longest_end"),
    )
