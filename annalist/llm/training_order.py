"""Training order: every token sequence gets a place in a shuffled order and is stored there.

Texts become token ids, one after the other, and are cut into sequences of a fixed length; only
the last sequence of a task's part is filled up. With ``n`` sequences in all, a Feistel network
on the least even number of bits that can hold ``n`` permutes their numbers; a number that
lands beyond ``n`` goes through the network again until it lands below (cycle walking). This
is a permutation of 0 to n - 1 that needs a key and no table, so each task computes its own.

Slots are cut into ranges of a fixed number of sequences, one file each, with two bytes a token
and no header: the bytes of a slot are found by multiplication, and a reader can stop and go
on at any slot. Files are written in one step under their final name, so a retried task
replaces a file by an equal one. A file is a range of slots and one group of a task, which tasks
share out by its number. Two bytes hold 65,536 ids; a tokenizer with more is refused.

Defined cases: null text is empty; an empty text is its end id; equal rows are stored each; an
empty table gives no files and no rows; other columns are left out; a very long text lies over many
sequences and is encoded in one task.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from annalist.llm import common
from annalist.llm.tokens import WordIds
from annalist.sources import shared

LENGTH = 2048
PER_SHARD = 4096
ROUNDS = 6
#: Sequences in one row of the stored stream.
IN_ROW = 64
#: Tasks that wrote the stream, up to which their offsets are sent to all executors.
MOST_PARTS = 1_000_000
#: Sequences that a task sorts by file before it passes them on.
IN_BLOCK = 8192


def feistel(numbers: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Where each number below ``n`` goes in a permutation of all of them."""
    half = max((int(n - 1).bit_length() + 1) // 2, 1)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 1 << 63, rounds, dtype=np.uint64)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        value = out[todo]
        left, right = value >> np.uint64(half), value & mask
        for k in keys:
            x = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Order:
    """What a reader needs to know; stored beside the files."""

    path: str
    sequences: int
    length: int
    per_shard: int
    key: int

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return feistel(numbers, self.sequences, self.key)

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.per_shard)

    def file(self, shard: int) -> str:
        return f"{self.path}/shard-{shard:08d}.u16"


def stream(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 1, fill_id: int = 0) -> DataFrame:
    """Rows of up to ``IN_ROW`` sequences: their ids, and which part of which document lies where.

    ``part`` and ``first`` number the sequences within the task that made them.
    """
    from tokenizers import Tokenizer

    if (ids := Tokenizer.from_file(tokenizer).get_vocab_size()) > 1 << 16:
        raise ValueError(f"{ids} ids do not fit in the two bytes of a token")
    common.ship(docs.sparkSession)
    source = common.text_column(docs)
    key = source.schema["doc_id"].dataType.simpleString()
    size = length * IN_ROW
    schema = (
        f"part int, first long, sequences int, ids binary, doc_id array<{key}>, start array<long>, at array<int>, count array<int>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, first = WordIds.of(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        kind = None
        held, held_size, docs_in = [], 0, ([], [], [], [])

        def row() -> pa.RecordBatch:
            sequences = -(-held_size // length)
            ids = np.full(sequences * length, fill_id, "<u2")
            ids[:held_size] = np.concatenate(held)
            lists = [pa.array([x], pa.list_(k)) for x, k in zip(docs_in, (kind, pa.int64(), pa.int32(), pa.int32()))]
            scalars = [pa.array([part], pa.int32()), pa.array([first]), pa.array([sequences], pa.int32()), pa.array([ids.tobytes()])]
            return pa.RecordBatch.from_arrays([*scalars, *lists], ["part", "first", "sequences", "ids", "doc_id", "start", "at", "count"])

        for batch in common.slices(batches, keep="tokens"):
            kind = batch.column("doc_id").type
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), encode.documents(common.raw_texts(batch))):
                ids = np.frombuffer(data + end, "<u4").astype("<u2")
                start = 0
                while start < len(ids):
                    piece = ids[start : start + size - held_size]
                    for values, value in zip(docs_in, (doc_id, start, held_size, len(piece))):
                        values.append(value)
                    held.append(piece)
                    held_size += len(piece)
                    start += len(piece)
                    if held_size == size:
                        yield row()
                        first += IN_ROW
                        held, held_size, docs_in = [], 0, ([], [], [], [])
        if held_size:
            yield row()

    return source.mapInArrow(run, schema)


def materialise(docs: DataFrame, tokenizer: str, key: int = 1, length: int = LENGTH, per_shard: int = PER_SHARD) -> tuple[Order, DataFrame]:
    """Write all files and return the order with a row for each part of a document in a sequence.

    The rows are ``doc_id, start, slot, offset, count, shard, byte, shard_crc32``: ``count`` ids
    of the document from ``start`` on stand in sequence ``slot`` from ``offset`` on, which is
    ``byte`` of file ``shard``.
    """
    import zstandard

    spark = docs.sparkSession
    path = shared.folder(spark, "training-order")
    found = stream(docs, tokenizer, length)
    found.write.option("compression", "zstd").parquet(f"{path}/stream")
    rows = spark.read.schema(found.schema).parquet(f"{path}/stream")
    # One row per task that wrote the stream: where its sequences begin among all.
    parts = rows.groupBy("part").agg(F.sum("sequences").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), "n")
    offsets = common.stage(offsets, "order-offsets")
    total = offsets.agg(F.sum("n")).first()[0] or 0
    rows = rows.join(common.by_size(spark, offsets.drop("n"), MOST_PARTS), "part")
    rows = rows.withColumn("first", F.col("first") + F.col("before"))
    order = Order(path, total, length, per_shard, key)
    common.publish(f"{path}/order.json", json.dumps(asdict(order)).encode())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        numbers, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            slots, data = order.slots(np.concatenate(numbers)), np.concatenate(ids)
            by = np.argsort(slots)
            shards = slots[by] // per_shard
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(by)]
            out: list[list] = [[], [], []]
            for a, b in zip(cuts, cuts[1:]):
                pick = by[a:b]
                out[0].append(int(shards[a]))
                out[1].append((slots[pick] % per_shard).astype("<i4").tobytes())
                out[2].append(packer.compress(data[pick].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *map(pa.array, out[1:])], ["shard", "rows", "ids"])

        for batch in batches:
            for first, n, data in zip(*(batch.column(c).to_pylist() for c in ("first", "sequences", "ids"))):
                numbers.append(first + np.arange(n))
                ids.append(np.frombuffer(data, "<u2").reshape(n, length))
                held += n
                if held >= IN_BLOCK:
                    yield flush()
                    numbers, ids, held = [], [], 0
        if held:
            yield flush()

    def write(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        size = min(per_shard, order.sequences - shard * per_shard)
        out = np.zeros((size, length), "<u2")
        unpack = zstandard.ZstdDecompressor()
        for at, data in zip(table.column("rows").to_pylist(), table.column("ids").to_pylist()):
            out[np.frombuffer(at, "<i4")] = np.frombuffer(unpack.decompress(data), "<u2").reshape(-1, length)
        data = out.tobytes()
        common.publish(order.file(shard), data)
        return pa.table({"shard": [shard], "shard_crc32": [zlib.crc32(data)]})

    dealt = rows.select("first", "sequences", "ids").mapInArrow(deal, "shard long, rows binary, ids binary")
    files = common.stage(dealt.groupBy("shard").applyInArrow(write, "shard long, shard_crc32 long"), "training-shards")

    key_type = found.schema["doc_id"].dataType.elementType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, count = np.array(row["at"], np.int64), np.array(row["count"], np.int64)
                start = np.array(row["start"], np.int64)
                last = (at + count - 1) // length
                pieces = last - at // length + 1
                owner = np.repeat(np.arange(len(at)), pieces)
                step = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                sequence = at[owner] // length + step
                low = np.maximum(at[owner], sequence * length)
                high = np.minimum(at[owner] + count[owner], (sequence + 1) * length)
                slots = order.slots(row["first"] + sequence)
                ids = pa.array(row["doc_id"], batch.schema.field("doc_id").type.value_type).take(pa.array(owner))
                columns = [start[owner] + low - at[owner], slots, low - sequence * length, high - low, slots // per_shard]
                byte = (slots % per_shard * length + low - sequence * length) * 2
                yield pa.RecordBatch.from_arrays(
                    [ids, *map(pa.array, columns), pa.array(byte)], ["doc_id", "start", "slot", "offset", "count", "shard", "byte"]
                )

    placed = rows.select("first", "doc_id", "start", "at", "count").mapInArrow(
        place, f"doc_id {key_type}, start long, slot long, offset long, count long, shard long, byte long"
    )
    return order, placed.join(files, "shard").select("doc_id", "start", "slot", "offset", "count", "shard", "byte", "shard_crc32")


def read(order: Order, first: int, count: int) -> Iterator[np.ndarray]:
    """Sequences in training order from a slot on, one file range at a time."""
    from pyarrow import fs

    width = 2 * order.length
    stop = min(first + count, order.sequences)
    while first < stop:
        shard, row = divmod(first, order.per_shard)
        n = min(order.per_shard - row, stop - first)
        system, place = fs.FileSystem.from_uri(order.file(shard))
        with system.open_input_file(place) as source:
            data = source.read_at(n * width, row * width)
        yield from np.frombuffer(data, "<u2").reshape(n, order.length)
        first += n
