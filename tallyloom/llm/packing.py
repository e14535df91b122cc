"""Best-fit packing of documents into sequences of at most capacity tokens.

Hierarchical residual packing: each partition packs its pieces best-fit by falling length. Bins that are
full or nearly so are emitted; underfull bins go up a tree as items, where fewer, larger nodes pack them
again, until one node is left. Only lengths and keys move; the ids stay where they are.

No node gets more than its share, and nothing is lost by that. Of a node's bins no two fit into one, or best fit
would have put the later one's first item into the earlier one; so at most one is no more than half full. Two bins
can merge only if one of them is. A parent of fan_in nodes thus makes fan_in merges at most, and takes no more bins
of any one fill. A node therefore passes on that many of each fill, fan_in * capacity in all at most:
the parent packs these as it would all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, workers
from .tokens import Encoder, tokenizer_path

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, item bigint"


def pieces_of(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Token pieces: doc_id, piece, start, length, ids_crc32, item (a number of its own).

    A document is its ids and end_id (a null text: end_id alone). Longer ones than capacity are cut into pieces of
    capacity ids, the first of which takes what remains. Rows with a repeated doc_id are cut each; a null doc_id stays.
    Texts are encoded whole, whatever their length. Other columns play no part, an empty table gives no pieces.
    """
    file = tokenizer or tokenizer_path()
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        item = TaskContext.get().partitionId() << 40
        encoder, end = Encoder.of(file), np.array([end_id], "<u4")
        for batch in batches:
            out: list[tuple] = []
            for name, ids in zip(batch.column(0).to_pylist(), encoder.encode(t.as_py() for t in batch.column(1))):
                ids = np.append(ids, end)
                n = len(ids)
                first = n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    out.append((name, k, a, b - a, zlib.crc32(ids[a:b]), item))
                    item += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return rows.mapInArrow(workers.task(cut, "tokens"), _PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed by falling length into the open bin that it leaves least room in.

    Bins are held by their room, so each step looks for the least room from the item's length up.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_by: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with room r is open
    made = 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = some >> n
        if n and fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_by[room].pop()
            if not open_by[room]:
                some &= ~(1 << room)
        else:
            b, room, made = made, capacity, made + 1
        bins[i], offset[i] = b, capacity - room
        left = room - n
        if left:
            open_by[left].append(b)
            some |= 1 << left
    return bins, offset


def pack(pieces: DataFrame, *, capacity: int = 1024, nearly_full: int | None = None, fan_in: int = 8, leaf_items: int = 50_000, leaves: int | None = None) -> DataFrame:
    """Place pieces (item, length, ...): adds sequence_id and offset; no sequence holds more than capacity.

    nearly_full: bins of so many tokens are emitted at once (default: all but 1/64). leaf_items: items of a partition, about;
    there are as many partitions as that takes. Ties fall to the smaller item.
    An empty table gives an empty one; a length that is null or over capacity raises.
    """
    full = nearly_full or capacity - capacity // 64
    alone = F.coalesce(F.col("length") >= full, F.lit(False))
    level = pieces.where(~alone).select(F.col("item").alias("unit"), F.col("length").alias("fill"))
    n = leaves or max(1, -(-level.count() // leaf_items))
    wrong = pieces.where("length is null or length > " + str(int(capacity))).select("length").first()
    if wrong:
        raise ValueError(f"a piece of {wrong[0]} tokens, where the capacity is {capacity}")
    made: list[DataFrame] = []  # unit, bin, offset, fill of the bin, up: whether the bin goes on as an item
    depth = 0
    while True:
        last = n == 1
        dealt = level.repartition(n, F.xxhash64("unit", F.lit(depth)))

        def place(batches: Iterator[pa.RecordBatch], depth: int = depth, last: bool = last) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            whole = pa.Table.from_batches(list(batches), schema=pa.schema([("unit", pa.int64()), ("fill", pa.int64())]))
            if not whole.num_rows:
                return
            unit, fill = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            order = np.argsort(unit, kind="stable")
            unit, fill = unit[order], fill[order]
            b, offset = best_fit(fill, capacity)
            total = np.bincount(b, weights=fill).astype(np.int64)
            by = np.argsort(total, kind="stable")
            rank = np.arange(len(by)) - np.searchsorted(total[by], total[by])  # among the bins of one fill
            up = np.zeros(len(total), bool)
            up[by] = (total[by] < full) & (rank < fan_in) & (not last)
            base = -((depth + 1) << 56) - (TaskContext.get().partitionId() << 34)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (unit, base - b, offset, total[b], up[b])], names=["unit", "bin", "offset", "total", "up"])

        placed = scratch.stored(dealt.mapInArrow(workers.task(place, "tokens"), "unit bigint, bin bigint, offset bigint, total bigint, up boolean"), f"pack{depth}")
        made.append(placed)
        if last:
            break
        level = placed.where("up").select(F.col("bin").alias("unit"), F.col("total").alias("fill")).distinct()
        n, depth = max(1, -(-n // fan_in)), depth + 1
    # A unit's place is the sum of the offsets on its way up the tree.
    place = made[-1].select("unit", F.col("bin").alias("sequence_id"), "offset")
    for lower in reversed(made[:-1]):
        above = place.select(F.col("unit").alias("bin"), F.col("sequence_id").alias("s"), F.col("offset").alias("o"))
        place = lower.join(above, "bin", "left").select("unit", F.coalesce("s", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("o", F.lit(0))).alias("offset"))
    own = pieces.where(alone).withColumn("sequence_id", F.col("item")).withColumn("offset", F.lit(0).cast("bigint"))
    return pieces.where(~alone).join(place.withColumnRenamed("unit", "item"), "item").unionByName(own).drop("item")


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    """docs to pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    capacity = how.get("capacity", 1024)
    return pack(scratch.stored(pieces_of(docs, capacity=capacity), "pieces"), **how)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(scratch.table(spark, sf_dir, "documents"))
