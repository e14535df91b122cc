"""Buckets, quotas and seeded samples."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import SamplingError
from ..functions import shuffles
from ..storage import stored


def label(high: float) -> str:
    whole = int(high) if float(high).is_integer() else high
    return f"<{whole // 60}min" if isinstance(whole, int) and whole >= 60 and whole % 60 == 0 else f"<{whole}s"


def buckets(edges: list[float], labels: list[str] | None = None) -> list[tuple[int, str, float, float]]:
    """(ord, label, low, high) of half-open buckets between rising edges; labels, if given, are one for each and differ."""
    if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:])):
        raise SamplingError(f"edges must rise, two at least: {edges}")
    names = labels if labels is not None else [label(b) for b in edges[1:]]
    if len(names) != len(edges) - 1 or len(set(names)) != len(names):
        raise SamplingError(f"a label for each of {len(edges) - 1} buckets, none twice: {names}")
    return [(i, n, float(a), float(b)) for i, (n, a, b) in enumerate(zip(names, edges, edges[1:]))]


def bucket_of(value: Column, edges: list[float], labels: list[str] | None = None) -> Column:
    """A value's bucket label, null outside."""
    out = F
    for _, name, low, high in buckets(edges, labels):
        out = out.when((value >= low) & (value < high), name)
    return out.otherwise(None)


def bucket_counts(rows: DataFrame, value: str, edges: list[float], labels: list[str] | None = None) -> DataFrame:
    """Every bucket with its number of rows, 0 included."""
    spark = rows.sparkSession
    dim = spark.createDataFrame(buckets(edges, labels), "ord int, bucket string, low double, high double")
    n = rows.groupBy(bucket_of(F.col(value), edges, labels).alias("bucket")).agg(F.count("*").alias("k"))
    return F.broadcast(dim).join(n, "bucket", "left").select("ord", "bucket", F.coalesce("k", F.lit(0)).alias("n"))


def allocate(total: int, n: int) -> list[int]:
    """total in n parts that differ by one at most, the larger first."""
    if n < 1 or total < 0:
        raise SamplingError(f"{total} in {n} parts")
    return [total // n + (i < total % n) for i in range(n)]


def first_k(rows: DataFrame, group: Column, order: list[str], k: int) -> DataFrame:
    ranked = rows.withColumn("bucket", group).where("bucket is not null")
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where(F.col("rank") <= k)


#: Fixed names, in the order in which they are looked for.
IDENTITY = ("sample_id", "id", "SENTENCE_NAME", "name")


def identity(rows: DataFrame) -> Column:
    """What tells rows apart: the first of the usual names that is there, else the whole row as JSON."""
    for c in IDENTITY:
        if c in rows.columns:
            return F.col(c).cast("string")
    return F.to_json(F.struct(*sorted(rows.columns)))


def ranked(rows: DataFrame, group: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """rows with their place from 1 in the order within their group, however large a group is.

    Rows are sorted over ranges of group and order; a row's place is its place in its range and the group's rows in the ranges before.
    The ranges are written out, as drawing them again would cut them elsewhere.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = stored(rows.repartitionByRange(n, *group, *order).withColumn("_range", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy("_range", *group).agg(F.count("*").alias("_here"))
    over = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1) if group else Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_range", *[F.col(g).alias(f"_g_{g}") for g in group], F.coalesce(F.sum("_here").over(over), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order))
    same = F.col("_range") == F.col("_r")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    met = dealt.withColumn("_within", within).join(before.withColumnRenamed("_range", "_r"), same)
    return met.withColumn(rank, (F.col("_within") + F.col("_before")).cast("int")).drop("_range", "_r", "_within", "_before", *[f"_g_{g}" for g in group])


def sample_buckets(rows: DataFrame, value: str, identity: str, edges: list[float], *, labels: list[str] | None = None, total: int | None = None, per_bucket: int | None = None, seed: int = 42) -> DataFrame:
    """A seeded sample of each bucket, the same as drawing from the rows sorted by identity as text.

    The draw depends on the buckets' sizes alone: these are counted, the ranks are drawn on the driver from one generator in
    the order of the buckets, and join with the rows' ranks. An empty bucket draws nothing. All columns of rows are sorted along, so
    leave out those that the sample needn't have. rank is the place among the bucket's rows.
    """
    if (total is None) == (per_bucket is None):
        raise SamplingError("exactly one of total and per_bucket")
    dim = buckets(edges, labels)
    quota = [per_bucket] * len(dim) if per_bucket is not None else allocate(total, len(dim))
    sizes = {r.bucket: r.n for r in bucket_counts(rows, value, edges, labels).collect()}  # a row for each bucket
    rng, drawn = random.Random(seed), []
    for (_, name, _, _), q in zip(dim, quota):
        take = min(q, sizes[name])
        if take:
            drawn += [(name, i + 1) for i in rng.sample(range(sizes[name]), take)]
    ranks = rows.sparkSession.createDataFrame(drawn, "bucket string, rank int")
    key = rows.withColumn("bucket", bucket_of(F.col(value), edges, labels)).where("bucket is not null").withColumn("_key", F.col(identity).cast("string"))
    return ranked(key, ["bucket"], ["_key"]).drop("_key").join(ranks, ["bucket", "rank"])


def round_robin(rows: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The first k rows taken in turn from each group, groups in order."""
    depth = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return rows.withColumn("depth", depth).where(F.col("depth") < k).orderBy("depth", group).limit(k)  # so no group is sorted whole


#: Places of a shuffle that one task follows.
FOLLOWED = 1_000_000


def _turns(spark: SparkSession, shuffles_of: list[tuple], k: int) -> DataFrame:
    """_group, _place (from 1), _turn (from 0) of the first k places of seeded shuffles, given as (group, n, state): worked out by tasks.

    A task follows FOLLOWED places of one shuffle at most; what the driver has of a shuffle is its size and a generator's state.
    """
    parts = [(g, n, *state, at, min(at + FOLLOWED, k, n)) for g, n, state in shuffles_of for at in range(0, min(k, n), FOLLOWED)]
    given = spark.createDataFrame(parts, "_group string, n bigint, key binary, pos int, low bigint, high bigint").repartition(max(1, len(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = shuffles.first_places((r["key"], r["pos"]), r["n"], r["high"], r["low"])
                yield pa.RecordBatch.from_arrays([pa.array([r["_group"]] * len(found), pa.string()), pa.array([p + 1 for p in found], pa.int64()), pa.array(range(r["low"], r["low"] + len(found)), pa.int64())], names=["_group", "_place", "_turn"])

    return given.mapInArrow(run, "_group string, _place bigint, _turn bigint")


def shuffled_limit(rows: DataFrame, order: str, k: int, seed: int = 42) -> DataFrame:
    """The first k of a seeded shuffle of all rows in order, as a list of them would be shuffled: tasks find the places, which join with the rows'."""
    chosen = _turns(rows.sparkSession, [("", rows.count(), shuffles.seeded(seed))], k).drop("_group")
    return ranked(rows, [], [order], "_place").join(chosen, "_place").orderBy("_turn").drop("_place", "_turn")


def stratified(rows: DataFrame, group: str, order: str, k: int, seed: int = 42) -> DataFrame:
    """k rows taken in turn from each group, groups in order, after a seeded shuffle of each group's rows.

    Groups are shuffled by one generator in the order in which their first rows come; the driver hands its state on from group to
    group and holds no group's places. k of 0 or less, or of all rows, takes all.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy("first").collect()  # a row for each group
    if k <= 0 or k >= sum(r.n for r in sizes):
        return rows
    state, given = shuffles.seeded(seed), []
    for r in sizes:
        given.append((None if r[group] is None else str(r[group]), r.n, state))
        state = shuffles.passed(state, r.n)
    low, deep = 0, k  # rounds that give k rows
    while deep - low > 1:
        middle = (low + deep) // 2
        low, deep = (low, middle) if sum(min(r.n, middle) for r in sizes) >= k else (middle, deep)
    turns = _turns(rows.sparkSession, given, deep).withColumnsRenamed({"_place": "_turn_rank", "_turn": "_depth"})
    met = ranked(rows, [group], [order], "_rank").join(turns, F.col(group).cast("string").eqNullSafe(F.col("_group")) & (F.col("_rank") == F.col("_turn_rank")))
    return met.orderBy("_depth", group).limit(k).drop("_rank", "_turn_rank", "_group", "_depth")


def first_wins(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Of rows with the same trimmed key the first; blank keys go. Keys are told apart by their SHA-256; a key's rows are reduced where they are before they meet."""
    first = rows.where(F.trim(key) != "").groupBy(F.sha2(F.trim(key), 256).alias("_key")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
