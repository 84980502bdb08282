"""Longest runs of active days from states that merge: 64 days in one number.

A group's days are kept as the bits of 64-bit words, one row per group and 64 days with activity.
Words of the same days merge by a bitwise or, so a state can be stored, joined with that of a later
load, and rolled up over repositories, authors and years without the events. The buffers are
numbers, so every step is a hash aggregation with partial sums. The longest run is read from the
bits: a run begins at a bit without a neighbour below, across words too, and ends at one without a
neighbour above; only these edges are listed, not the days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import fields
from annalist.functions.timefn import DAY

_BITS = 64


def streak_state(df: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """``*group_cols, word, bits``: the UTC days of each group; unparseable times are skipped."""
    day = F.call_function("div", fields.seconds(df), F.lit(DAY))
    days = df.select(*group_cols, day.alias("__day")).filter("__day IS NOT NULL")
    word = F.floor(F.col("__day") / _BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("__day", F.lit(_BITS)).cast("int"))
    return days.groupBy(*group_cols, word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def merge_states(states: Sequence[DataFrame], group_cols: Sequence[str]) -> DataFrame:
    """One state of several, for the groups given; columns beyond these are rolled up."""
    both = states[0].select(*group_cols, "word", "bits")
    for state in states[1:]:
        both = both.unionByName(state.select(*group_cols, "word", "bits"))
    return both.groupBy(*group_cols, "word").agg(F.bit_or("bits").alias("bits"))


def _places(bits: Column) -> Column:
    """The places of the bits that are set, in order."""
    return F.filter(F.sequence(F.lit(0), F.lit(_BITS - 1)), lambda i: F.call_function("getbit", bits, i) == 1)


def longest_of_state(state: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """``longest_streak``'s columns for each group that a state has; the earliest run on a tie.

    A group meets in one row with its words, which the calendar bounds: some six a year.
    """
    words = state.groupBy(*group_cols).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))
    one = F.lit(1).cast("long")
    shifted = lambda name, bits, by: F.call_function(name, bits, F.lit(by))

    def edges(starts: bool) -> Column:
        """Days on which runs begin or end, over all words."""

        def of(x: Column, i: Column) -> Column:
            near = F.get("w", i - 1 if starts else i + 1)
            touches = near["word"] == (x["word"] - 1 if starts else x["word"] + 1)
            if starts:
                below = shifted("shiftrightunsigned", near["bits"], _BITS - 1)
                beside = shifted("shiftleft", x["bits"], 1).bitwiseOR(F.when(touches, below).otherwise(F.lit(0).cast("long")))
            else:
                above = shifted("shiftleft", near["bits"].bitwiseAND(one), _BITS - 1)
                beside = shifted("shiftrightunsigned", x["bits"], 1).bitwiseOR(F.when(touches, above).otherwise(F.lit(0).cast("long")))
            edge = x["bits"].bitwiseAND(F.bitwise_not(beside))
            return F.transform(_places(edge), lambda place: x["word"] * _BITS + place)

        return F.flatten(F.transform("w", of))

    runs = words.select(*group_cols, edges(True).alias("__starts"), edges(False).alias("__ends"))
    # The longest run, then the earliest: its length and the negative of its first day.
    best = F.array_max(F.zip_with("__starts", "__ends", lambda s, e: F.struct((e - s + 1).alias("n"), (-s).alias("s"))))
    found = runs.select(*group_cols, best.alias("__best"))
    start = -F.col("__best.s")
    text = lambda day: F.date_from_unix_date(day.cast("int")).cast("string")
    return found.select(
        *group_cols,
        F.col("__best.n").alias("active_longest_days"),
        text(start).alias("active_longest_start"),
        text(start + F.col("__best.n") - 1).alias("active_longest_end"),
    )


def streak_rollup(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Longest streaks for several groupings at once, as ``GROUPING SETS`` give them.

    One scan: events become the state of the finest grouping, and each set is rolled up from it.
    A column that a set leaves out is NULL; ``grouping`` is Spark's grouping id of the columns in
    the order in which the sets name them first, which tells such a NULL from one in the data.
    Only rows of the state are expanded and shuffled again.
    """
    finest = list(dict.fromkeys(c for one in sets for c in one))
    columns = [F.col(c) for c in (*finest, "word")]
    lists = [[F.col(c) for c in (*one, "word")] for one in sets]
    rolled = (
        streak_state(df, finest)
        .groupingSets(lists, *columns)
        .agg(F.bit_or("bits").alias("bits"), F.shiftright(F.grouping_id(), 1).alias("grouping"))
    )
    return longest_of_state(rolled, ["grouping", *finest])
