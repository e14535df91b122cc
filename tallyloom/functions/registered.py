"""Functions for SQL: what has no expression in Catalyst, under names of its own."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text

#: Name in SQL -> function: of a text, and of two arrays of words.
FUNCTIONS = {"tallyloom_normalise": text.normalise_exact, "tallyloom_word_edits": text._word_edits}


def register_functions(spark: SparkSession) -> list[str]:
    """Register them in a session; returns their names."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    return sorted(FUNCTIONS)
