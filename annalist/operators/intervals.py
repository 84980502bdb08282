"""Join of points with the intervals they lie in, without comparing all with all.

The axis is cut in bins. An interval is put in the bins it touches, a point in its own, and both
meet by equality of the bin, where the range condition decides. Intervals of very different length
have bins of different width, by powers of ``_STEP``, so that none touches more than ``_MOST``
bins; a point is put in one bin of each width that some interval has, a few at most.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.sources import shared

_STEP = 8
_MOST = 9
#: Widths from one bin up to the whole range of a bigint.
_LEVELS = 22


def _bin(value: Column, width: Column) -> Column:
    """The number of the bin; exact for all of bigint, below zero too."""
    down = F.pmod(value, width)
    return F.call_function("div", value - down, width)


def interval_join(
    points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int = 1, how: str = "inner"
) -> DataFrame:
    """Each point with each interval that has ``start <= at < end``; the three are integers.

    ``how`` is ``inner`` or ``left``: with ``left`` a point in no interval stays, with NULLs.
    ``width`` is the narrowest bin: about the length of a usual interval. Column names of both
    sides must differ. Empty intervals, and NULLs on either side, meet nothing. Points that occur
    in very many intervals give as many rows; a bin with very many points is split by adaptive
    execution like any skewed key.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"not a kind of this join: {how}")
    ranged = intervals.filter(F.col(start) < F.col(end))
    length = F.col(end) - F.col(start)
    level = F.lit(_LEVELS - 1)
    for n in range(_LEVELS - 2, -1, -1):
        wide = min(width * _STEP**n * (_MOST - 1), (1 << 63) - 1)
        level = F.when(length <= F.lit(wide), n).otherwise(level)
    ranged = ranged.withColumn("__level", level)
    widths = F.array(*[F.lit(min(width * _STEP**n, 1 << 62)).cast("long") for n in range(_LEVELS)])
    own = F.get(widths, F.col("__level"))
    touched = F.sequence(_bin(F.col(start), own), _bin(F.col(end) - 1, own))
    binned = ranged.withColumn("__bin", F.explode(touched))
    # The levels in use, as an array of one row: at most one entry for each level.
    used = ranged.select(F.coalesce(F.collect_set("__level"), F.array().cast("array<int>"))).scalar()
    if how == "inner":
        keyed = points.filter(F.col(at).isNotNull())
    else:
        # Stored, so that the numbers of the rows are the same wherever they are used.
        path = shared.folder(points.sparkSession, "points")
        points.withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
        keyed = points.sparkSession.read.parquet(path)
    place = keyed.withColumn("__level", F.explode(used))
    place = place.withColumn("__bin", _bin(F.col(at), F.get(widths, F.col("__level"))))
    inside = (F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))
    met = place.join(binned, ["__level", "__bin"]).filter(inside).drop("__level", "__bin")
    if how == "inner":
        return met
    alone = keyed.join(met.select("__row").distinct(), "__row", "left_anti")
    return met.unionByName(alone, allowMissingColumns=True).drop("__row")


def interval_sums(
    points: DataFrame,
    intervals: DataFrame,
    at: str,
    start: str,
    end: str,
    sums: Mapping[str, str],
    count: str,
    width: int = 1,
) -> DataFrame:
    """Each interval that some point lies in, with the number of its points and sums over them.

    ``sums`` gives the columns of ``points`` to add up, by the name of the result. Points of one
    place are added up first, and intervals with equal ends meet them once, so that the join
    grows with the different places and ends, not with the pairs of rows.
    """
    place = points.filter(F.col(at).isNotNull()).groupBy(F.col(at).alias("__at"))
    places = place.agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    ranged = intervals.filter(F.col(start) < F.col(end))
    ends = ranged.select(F.col(start).alias("__start"), F.col(end).alias("__end")).distinct()
    met = interval_join(places, ends, "__at", "__start", "__end", width)
    found = met.groupBy("__start", "__end").agg(
        F.sum("__n").alias(count), *[F.sum(f"__{n}").alias(n) for n in sums]
    )
    same = (F.col(start) == F.col("__start")) & (F.col(end) == F.col("__end"))
    return ranged.join(found, same).drop("__start", "__end")
