"""Connected components of a table of links, by alternating stars; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(links: DataFrame, a: str = "a", b: str = "b", files: int | None = None) -> DataFrame:
    """node, root: for every node of links the smallest node that it is connected with.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest; rounds grow with the
    logarithm of the longest path. Rounds are written out, so lineage stays short. Null ends and loops are ignored.
    files: how many the links are written to at first.
    """
    edges = scratch.stored(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links", files)
    before = _print(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(small, "u")
        now = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.stored(now, "links", scratch.files_for(before[0], 100_000))
        after = _print(now)
        scratch.discard(edges)
        edges = now
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _print(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return r[0], int(r[1])
