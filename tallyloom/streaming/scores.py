"""Scoring as predictions arrive: an extension to the batch operators, with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mcq


def scored_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """MCQ predictions of JSONL files as they come, with their scores."""
    rows = spark.readStream.schema(schema).json(folder)
    return rows.withColumns({f"score_{k}": v for k, v in mcq.mcq_scores(F.col("ground_truth"), F.col("model_output")).items()})


def windowed_means(rows: DataFrame, ts: str, by: str, metric: str, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Means per window and group; what is later than the watermark is left out, so state stays bounded."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.count("*").alias("n"), F.avg(metric).alias(metric))
