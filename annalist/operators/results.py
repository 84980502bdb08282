"""Shape aggregated results for charts: arrays, series, shares, rounding."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.sources import shared


def column_arrays(result: DataFrame, order: Sequence[str]) -> DataFrame:
    """A report result as one row with an array per column, rows in the given order.

    Meant for aggregated results, whose rows are the points of a chart: all of them meet in
    one row. NULLs are kept.
    """
    row = F.struct(*order, F.struct(*result.columns).alias("__row"))
    packed = result.agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    return packed.select(
        *[F.col("__rows").getField("__row").getField(c).alias(c) for c in result.columns]
    )


def array_blocks(result: DataFrame, order: Sequence[str], rows: int = 100_000) -> DataFrame:
    """``column_arrays`` in numbered blocks of ``rows`` rows, for results of any size.

    Gives ``block`` from 0, ``first``, the position of its first row among all, and an array per
    column. Rows are dealt by ranges of the order and sorted within them; the number of rows of
    each range, one number a range, gives every row its exact position, so all blocks but the
    last are full and no task holds more than its blocks. Rows equal in all of ``order`` stand
    next to each other in any order. A column named like one of the two new ones is refused.
    """
    if {"block", "first"} & {c.lower() for c in result.columns}:
        raise ValueError("columns named block or first")
    spark = result.sparkSession
    number = F.monotonically_increasing_id()
    placed = (
        result.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            F.shiftright(number, 33).alias("__range"),
            number.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"),
            F.struct(*result.columns).alias("__row"),
        )
    )
    path = shared.folder(spark, "ordered")
    placed.write.parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    offsets = offsets.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    position = F.col("__at") + F.col("__before")
    numbered = stored.join(offsets, "__range").select(position.alias("__position"), "__row")
    block = F.call_function("div", F.col("__position"), F.lit(rows)).alias("block")
    packed = numbered.groupBy(block).agg(
        F.array_sort(F.collect_list(F.struct("__position", "__row"))).alias("__rows")
    )
    return packed.select(
        "block",
        (F.col("block") * rows).alias("first"),
        *[F.col("__rows").getField("__row").getField(c).alias(c) for c in result.columns],
    )


def parse_binding(text: str) -> "tuple[int, str] | None":
    """``${column}`` or ``${i:column}`` as (statement index, column); None for a literal."""
    start, end = text.find("${"), text.find("}")
    if start < 0 or end <= start + 2:
        return None
    index, colon, column = text[start + 2 : end].partition(":")
    if not colon:
        return 0, index
    return (int(index), column) if index.isascii() and index.isdigit() else None


def chart_series(
    results: Sequence[DataFrame], label: str, datasets: Mapping[str, str]
) -> DataFrame:
    """Labels and one column per dataset, bound from the results of several statements.

    A dataset of another statement is joined on the label column rather than taken by row
    position. A label that only some statements have keeps its values, NULL labels meet, and
    what a statement lacks is NULL. A binding to an unknown statement or column gives NULLs, a literal its text.
    """

    def bound(text):
        at = parse_binding(text)
        if at is None:
            return F.lit(text)
        return at if at[0] < len(results) and at[1] in results[at[0]].columns else F.lit(None)

    base = bound(label)
    if isinstance(base, Column):
        raise ValueError(f"the label must be a column of a result: {label}")
    label_of, label_column = base
    wanted = {name: bound(text) for name, text in datasets.items()}
    series = results[label_of].select(
        F.col(label_column).alias("label"),
        *[
            F.col(b[1]).alias(name)
            for name, b in wanted.items()
            if not isinstance(b, Column) and b[0] == label_of
        ],
    )
    for index in sorted({b[0] for b in wanted.values() if not isinstance(b, Column)}):
        if index == label_of:
            continue
        other = results[index].select(
            F.col(label_column).alias("label"),
            *[
                F.col(b[1]).alias(name)
                for name, b in wanted.items()
                if not isinstance(b, Column) and b[0] == index
            ],
        )
        other = other.withColumnRenamed("label", "__label")
        same = F.col("label").eqNullSafe(F.col("__label"))
        series = series.join(other.withColumn("__there", F.lit(True)), same, "full")
        label_or = F.when(F.col("__there") & F.col("label").isNull(), F.col("__label"))
        series = series.withColumn("label", F.coalesce(label_or, "label")).drop("__label", "__there")
    return series.select(
        "label",
        *[b.alias(name) if isinstance(b, Column) else F.col(name) for name, b in wanted.items()],
    )


def chart_arrays(
    results: Sequence[DataFrame],
    orders: Sequence[Sequence[str]],
    labels: Sequence,
    datasets: Mapping[str, Sequence],
) -> DataFrame:
    """The data part of a chart: one row with ``labels`` and an array per dataset.

    Labels and datasets are lists of items. A binding stands for all values of its column,
    in the order given for its result; anything else is kept as it is; a binding to an
    unknown statement or column adds nothing. Each bound array is a scalar subquery.
    """
    arrays = [column_arrays(result, order) for result, order in zip(results, orders)]

    def joined(items, kind):
        parts = [F.array().cast(f"array<{kind}>")]
        for item in items:
            at = parse_binding(item) if isinstance(item, str) else None
            if at is None:
                parts.append(F.array(F.lit(item)).cast(f"array<{kind}>"))
            elif at[0] < len(arrays) and at[1] in arrays[at[0]].columns:
                parts.append(arrays[at[0]].select(F.col(at[1]).cast(f"array<{kind}>")).scalar())
        return F.concat(*parts)

    return (
        results[0]
        .sparkSession.range(1)
        .select(
            joined(labels, "string").alias("labels"),
            *[joined(items, "double").alias(name) for name, items in datasets.items()],
        )
    )


def with_share(result: DataFrame, value: str) -> DataFrame:
    """Add ``share``, the percentage of the total as text with two decimals.

    The total is a scalar subquery, so the rows stay where they are.
    """
    total = result.select(F.sum(value)).scalar()
    percent = F.col(value) / total * 100
    return result.withColumn("share", F.concat(_hundredths(percent), F.lit("%")))


def _hundredths(percent: Column) -> Column:
    """A number as text with two decimals, rounded from its exact binary value, halves up in size.

    The number is cut in two parts whose products below are exact, so that a half is a half and
    not what has been rounded to one.
    """
    size = F.abs(percent)
    high = F.floor(size * 1048576) / 1048576.0
    below = F.floor(size * 100)
    beyond = (high * 200 - (2 * below + 1)) + (size - high) * 200
    n = below + F.when(beyond >= 0, 1).otherwise(0)
    whole, rest = F.call_function("div", n, F.lit(100)), n % 100
    text = F.concat(whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), 2, "0"))
    return F.concat(F.when(percent < 0, "-").otherwise(""), text)


def round2(c: "Column | str") -> Column:
    """Round to two decimals, halves up (towards plus infinity)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 100 + 0.5) / 100
