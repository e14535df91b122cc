"""Token-ID output in Simple-8b words.

A word has a 4-bit selector (its top bits) and 60 bits of payload. SLOTS gives how many ids a selector
packs and how wide each is. Selector 0 is the escape: its payload is an index into the block's table of
raw 64-bit values, for values that need more than 60 bits. The file format is a Parquet table with a row
for each block of whole documents in ascending doc_id order:

shard, block: place of the block; before: ids of its shard before it; doc_ids: its documents; doc_ends: per document the ids of the block up
to its end; n_ids; words: the packed words, little-endian; raw: escaped values; part_words: for each
PART_WORDS words, the ids before them, so a reader may start in the middle of a block.

A reader decodes a block without a loop over words: ids per word follow from the selectors, places from
their running sum, and each selector's words unpack at once.
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

#: (ids in a word, bits of each) by selector; fixed values of the coding, but for the escape at 0.
SLOTS = [(1, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNT = np.array([c for c, _ in SLOTS], dtype=np.int64)
#: The bits of each value below 2 ** 16.
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
PART_WORDS = 4096
#: Ids after which a block is closed; a longer document makes a longer block.
BLOCK_IDS = 1 << 17


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and raw values of uint64 ids. The last word may hold zeros beyond the last id."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    # Bits of each id, and the most of any window from each place on, by doubling; zeros follow the last id.
    bits = np.zeros(n + 240, np.uint8)
    if ids.max() <= 0xFFFF:
        bits[:n] = _BITS[ids.astype(np.uint16)]
    else:
        bits[:n] = np.frexp(ids.astype(np.float64))[1]
        bits[:n][ids >= np.uint64(1) << np.uint64(60)] = 64
    pick = np.full(n, 15, dtype=np.int8)
    pick[bits[:n] > 60] = 0
    widest = {1: bits}
    for k in range(14, 0, -1):  # the selector with most ids that fits from each place on
        count, width = SLOTS[k]
        if count not in widest:
            half = max(c for c in widest if c < count)
            other = count - half if count - half in widest else half
            most = widest[half]
            widest[count] = np.maximum(most[: len(most) - (count - other)], widest[other][count - other : count - other + len(most) - (count - other)])
        fits = widest[count][:n] <= width
        if not fits.any():  # nor do more ids fit into narrower slots
            break
        np.copyto(pick, k, where=fits)
    step = _COUNT[pick].tolist()
    at, starts = 0, []
    while at < n:
        starts.append(at)
        at += step[at]
    start = np.array(starts, dtype=np.int64)
    chosen = pick[start]
    padded = np.concatenate([ids, np.zeros(120, np.uint64)])
    words = chosen.astype(np.uint64) << np.uint64(60)
    raw = np.empty(0, np.uint64)
    for k in range(16):
        here = np.flatnonzero(chosen == k)
        if not len(here):
            continue
        if k == 0:
            raw = ids[start[here]]
            words[here] |= np.arange(len(here), dtype=np.uint64)
        elif SLOTS[k][1]:
            count, bits = SLOTS[k]
            for j in range(count):
                words[here] |= padded[start[here] + j] << np.uint64(j * bits)
    return words, raw


def unpack(words: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    """The n ids (uint64) of pack()'s words."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(_COUNT[chosen])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    start = ends - _COUNT[chosen]
    body = words & np.uint64((1 << 60) - 1)
    for k in range(16):
        here = np.flatnonzero(chosen == k)
        if not len(here):
            continue
        count, bits = SLOTS[k]
        if k == 0:
            out[start[here]] = raw[body[here].astype(np.int64)]
        elif bits:
            shift = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[(start[here][:, None] + np.arange(count)).ravel()] = ((body[here][:, None] >> shift) & np.uint64((1 << bits) - 1)).ravel()
    return out[:n]


_FORMAT = "shard int, block int, before bigint, doc_ids array<bigint>, doc_ends array<bigint>, n_ids bigint, words binary, raw binary, part_words array<bigint>"


def write_ids(docs: DataFrame, path: str, *, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, end_id: int = 0, shards: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode docs and write the format above to path, as path/blocks and path/shards (ids of each shard and before it).

    Nulls: a null text is empty and holds the end id alone; a null doc_id sorts first. Repeated doc_ids keep
    all their rows, in the order of their texts' hashes. Extra columns are ignored. An empty table makes an empty one.
    """
    spark = docs.sparkSession
    file = tokenizer or tokenizer_path()
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, done = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        kept: list[np.ndarray] = []
        size = 0
        encoder, end = Encoder.of(file, 800_000), np.array([end_id], "<u4")

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(kept).astype(np.uint64)
            words, raw = pack(ids)
            before = np.concatenate([[0], np.cumsum(_COUNT[(words >> np.uint64(60)).astype(np.int64)])])[:-1:PART_WORDS]
            ends = np.cumsum([len(x) for x in kept]).reshape(-1, 2)[:, 1]
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "before": pa.array([done], pa.int64()), "doc_ids": pa.array([names], pa.list_(pa.int64())),
                "doc_ends": pa.array([ends.tolist()], pa.list_(pa.int64())), "n_ids": pa.array([len(ids)], pa.int64()), "words": [words.astype("<u8").tobytes()],
                "raw": [raw.astype("<u8").tobytes()], "part_words": pa.array([before.tolist()], pa.list_(pa.int64())),
            })

        for batch in batches:
            ids_of = encoder.encode(t.as_py() for t in batch.column(1))
            for name, ids in zip(batch.column(0).to_pylist(), ids_of):
                names.append(name)
                kept += (ids, end)
                size += len(ids) + 1
                if size >= block_ids:
                    yield closed()
                    names, kept, size, block, done = [], [], 0, block + 1, done + size
        if names:
            yield closed()

    dealt.mapInArrow(workers.task(encode, "tokens", fast=True), _FORMAT).write.parquet(f"{path}/blocks")
    blocks = spark.read.schema(_FORMAT).parquet(f"{path}/blocks")
    totals = sorted((r.shard, r.ids) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids")).collect())  # a row for each task of the write
    before, index = 0, []
    for shard, ids in totals:
        index.append((shard, ids, before))
        before += ids
    spark.createDataFrame(index, "shard int, n_ids bigint, ids_before bigint").coalesce(1).write.parquet(f"{path}/shards")


def read_ids(spark, path: str, *, with_ids: bool = False) -> DataFrame:
    """Decode what write_ids() wrote: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array<bigint>)."""
    blocks = spark.read.schema(_FORMAT).parquet(f"{path}/blocks")
    shards = spark.read.schema("shard int, n_ids bigint, ids_before bigint").parquet(f"{path}/shards")
    # A row for each task of the write, so it may be sent; blocks stay where they are.
    placed = blocks.join(F.broadcast(shards.select("shard", "ids_before")), "shard").select((F.col("ids_before") + F.col("before")).alias("before"), "doc_ids", "doc_ends", "n_ids", "words", "raw")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                before, names, ends, n, words, raw = (batch.column(i)[r].as_py() for i in range(6))
                ids = unpack(np.frombuffer(words, "<u8"), np.frombuffer(raw, "<u8"), n)
                low = np.ascontiguousarray(ids, dtype="<u4")
                cuts = [0, *ends]
                made = {
                    "doc_id": pa.array(names, pa.int64()), "start": pa.array([before + x for x in cuts[:-1]], pa.int64()),
                    "n_tokens": pa.array(np.diff(cuts), pa.int64()), "ids_crc32": pa.array([zlib.crc32(low[a:b].tobytes()) for a, b in zip(cuts, ends)], pa.int64()),
                }
                if with_ids:
                    made["ids"] = pa.array([ids[a:b].astype(np.int64) for a, b in zip(cuts, ends)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(made)

    return placed.mapInArrow(workers.task(decode, "tokens", fast=True), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def op1_simple8b(spark, sf_dir: str) -> DataFrame:
    path = scratch.scratch_path(spark, "ids")
    write_ids(scratch.table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path)
