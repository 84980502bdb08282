"""Best-fit packing whose bin counts are certified by lower bounds.

Documents become token ids, longer ones are cut into full pieces, and the rest is packed into
sequences of a fixed capacity. Rows are dealt into groups of bounded size and each group runs
best-fit decreasing. Dual-feasible functions give a lower bound on the bins any packing of the
group needs. A group that meets its bound is finished: no exchange inside it can save a bin.
Groups above it release all bins that are not full, these documents are dealt anew into as few
groups as the size bound allows, and best-fit decreasing runs again.

Defined cases: null text is empty, an empty document is the closing id alone, equal rows are
packed one by one, an empty table gives no rows, any other column is left out. Of bins with equal
room the last one opened or used is taken, of equal lengths the first row. Special strings in a
text are the tokenizer's special ids. A very long text gives many pieces, made in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count as count_up

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from annalist.llm import common
from annalist.llm.tokens import WordIds

PIECES = (
    "doc_id {key}, piece int, start long, length long, ids_crc32 long, ids binary"
)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``capacity`` ids: one row per piece, ids only if asked for.

    ``ids`` are little-endian unsigned 32-bit numbers, ``ids_crc32`` is their checksum.
    """
    spark = docs.sparkSession
    common.ship(spark)
    source = common.text_column(docs)
    schema = PIECES.format(key=source.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds.of(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in common.slices(batches, keep="tokens"):
            rows: list[int] = []
            numbers, starts, lengths, sums, kept = [], [], [], [], []
            for row, data in enumerate(encode.documents(common.raw_texts(batch))):
                data += end
                for number, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append(row)
                    numbers.append(number)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    kept.append(part if keep_ids else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
            )

    found = source.mapInArrow(run, schema)
    return found if keep_ids else found.drop("ids")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every length, and the free space left in every bin.

    Open bins are kept by free space; a bit set of the spaces in use finds the tightest one.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    stacks: dict[int, list[int]] = {}
    free: list[int] = []
    spaces = 0
    for i in order.tolist():
        need = int(lengths[i])
        fitting = spaces >> need
        if fitting:
            space = need + (fitting & -fitting).bit_length() - 1
            stack = stacks[space]
            b = stack.pop()
            if not stack:
                spaces ^= 1 << space
        else:
            space, b = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - space
        left = space - need
        free[b] = left
        if left:
            stack = stacks.setdefault(left, [])
            if not stack:
                spaces |= 1 << left
            stack.append(b)
    return bins, offsets, np.array(free, np.int64)


def least_bins(lengths: np.ndarray, capacity: int, steps: int = 20) -> int:
    """Lower bound on the bins for these lengths: the best of two families of dual-feasible functions.

    The first rounds lengths above ``capacity - e`` up to a whole bin and drops those below
    ``e``, for every ``e`` up to half a bin. The second rounds down to multiples of
    ``1 / (k + 1)`` of a bin and charges ``1 / k`` for each, for ``k`` up to ``steps``.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = count * np.arange(capacity + 1)
    below_count = np.concatenate([[0], np.cumsum(count)])
    below_size = np.concatenate([[0], np.cumsum(size)])
    e = np.arange(0, capacity // 2 + 1)
    large = len(lengths) - below_count[capacity - e + 1]
    middle = below_size[capacity - e + 1] - below_size[e]
    best = int(np.max(large - (-middle // capacity)))
    values = np.arange(capacity + 1, dtype=np.int64)
    for k in range(1, steps + 1):
        whole = values * (k + 1) % capacity == 0
        # Charges in units of 1 / (k * capacity): exact lengths pay their share, others floor.
        charge = np.where(whole, values * k, values * (k + 1) // capacity * capacity)
        best = max(best, int(-(-int((charge * count).sum()) // (k * capacity))))
    return best


def pack(items: DataFrame, capacity: int, rows_in_group: int = 50_000, rounds: int | None = None) -> DataFrame:
    """Add ``sequence_id``, ``offset`` and ``certified`` to rows that have a ``length``.

    ``rows_in_group`` bounds what one task holds; it is a size, not a cap: all rows are packed
    at any number of groups. ``certified`` says that the group met its lower bound. The exchange
    goes on until all groups are certified or a round has saved no bin, so it ends by itself;
    ``rounds`` ends it earlier.
    """
    rows = common.stage(items.withColumn("_row", F.monotonically_increasing_id()), "pack-rows")
    full = rows.where(F.col("length") >= capacity).select(
        *items.columns,
        (F.lit(1 << 62) + F.col("_row")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(True).alias("certified"),
    )
    done = [full]
    rest = rows.where(F.col("length") < capacity)
    added = [T.StructField(x, T.LongType()) for x in ("_bin", "offset", "_free", "_gap", "_group")]
    out = T.StructType([*rest.schema.fields, *added])

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_row", "ascending")]).combine_chunks()
        lengths = group.column("length").to_numpy().astype(np.int64)
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        gap = len(free) - least_bins(lengths, capacity)
        names = [x for x in group.column_names if x != "_group"]
        return pa.table(
            [group.column(x) for x in names]
            + [
                pa.array(bins),
                pa.array(offsets),
                pa.array(free[bins]),
                pa.array(np.full(len(bins), gap, np.int64)),
                group.column("_group"),
            ],
            names=names + ["_bin", "offset", "_free", "_gap", "_group"],
        )

    bins_before = None
    for number in count_up() if rounds is None else range(rounds):
        count = rest.count()
        if not count:
            break
        groups = -(-count // rows_in_group)
        dealt = rest.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(number)), F.lit(groups)))
        filled = common.stage(dealt.groupBy("_group").applyInArrow(fill, out), "pack-round")
        named = filled.withColumn(
            "sequence_id",
            F.lit(number << 56) + F.shiftleft(F.col("_group"), 24) + F.col("_bin"),
        ).withColumn("certified", F.col("_gap") == 0)
        open_bins = (F.col("_gap") > 0) & (F.col("_free") > 0)
        used = filled.where(open_bins).agg(
            F.countDistinct("_group", "_bin").alias("bins"), F.countDistinct("_group").alias("groups")
        ).first()
        # One group that is left above its bound, or no bin saved by the last exchange: as good as it gets.
        saved = bins_before is None or used["bins"] < bins_before
        last = number + 1 == rounds or used["groups"] <= 1 and groups == 1 or not saved
        keep = named if last else named.where(~open_bins)
        done.append(keep.select(*items.columns, "sequence_id", "offset", "certified"))
        if last or not used["bins"]:
            break
        bins_before = used["bins"]
        rest = filled.where(open_bins).select(rest.columns)
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and the place in it that each one gets."""
    return pack(pieces(docs, tokenizer, capacity, keep_ids=keep_ids), capacity)
