"""Bounded samples of labelled rows, and the fold that is never learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; 0 is held out. A null id is in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def classes_of(rows: DataFrame, label: str) -> DataFrame:
    """label and count: about how many distinct ids each class has, from sketches, so that ids aren't shuffled."""
    return scratch.stored(rows.groupBy(label).agg(F.approx_count_distinct("doc_id").alias("count")), "classes", 8)


def chosen(rows: DataFrame, label: str, per_class: int, classes: DataFrame) -> DataFrame:
    """doc_id, label of up to per_class ids of each class, those with the least hashes; an id counts once, however many rows it has.

    A bound on the hash leaves about four times the ids wanted of each class, so no class's ids are all sorted.
    """
    hashed = rows.select("doc_id", label, F.xxhash64("doc_id").alias("h"))
    near = hashed.join(F.broadcast(classes), label).where((F.col("h") / float(1 << 64) + 0.5) * F.col("count") <= 4 * per_class + 40)
    near = near.groupBy("doc_id", label).agg(F.min("h").alias("h"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("h", "doc_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= per_class).select("doc_id", label)


def one_text(rows: DataFrame, label: str, ids: DataFrame) -> DataFrame:
    """doc_id, label, text of the ids, which are few enough to be sent to all tasks: of an id's texts the one with the least hash."""
    met = rows.join(F.broadcast(ids), ["doc_id", label]).groupBy("doc_id", label).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    return met.select("doc_id", label, "x.text")
