"""Helpers of the operators here: intermediate tables, names that clash with none, and sizes of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, files_for, kept, scratch_path, shared_dir, stored, working

__all__ = ["discard", "files_for", "kept", "private", "scratch_path", "shared_dir", "small_enough", "spread_join", "stored", "table", "working"]


def private(docs: DataFrame, *names: str) -> list[str]:
    """The names with a prefix that no column of docs starts with."""
    taken = [c.lower() for c in docs.columns]
    prefix = "_"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return [prefix + n for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows; reads no more than limit + 1 of them."""
    return df.limit(limit + 1).count() <= limit


def spread_join(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """left with what right has for its keys: a row for each, with the number of left's rows (total in all) that have it.

    Keys of many rows are sent to all tasks, so that their rows don't meet in one: fewer than 100,000 of them, whatever the total.
    """
    limit = max(1000, total // 100_000)
    hot = F.broadcast(right.where(F.col(count) > limit).drop(count))
    rest = left.join(F.broadcast(right.where(F.col(count) > limit).select(*on)), on, "left_anti").join(right.where(F.col(count) <= limit).drop(count), on)
    return left.join(hot, on).unionByName(rest)
