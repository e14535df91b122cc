"""Manifests: readers, checks, canonical columns and the ordered single-file writer."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ManifestError
from . import csv_records, one_file

#: Fixed order of the core columns.
CORE = (
    "sample_id", "experiment", "condition", "media_type", "media_path", "media_filename", "ground_truth", "ground_truth_path", "fps", "duration_sec",
    "n_frames", "width", "height", "codec", "file_size_bytes", "seed", "run_id", "config_hash", "pov_version", "generated_at",
)
KINDS = {"fps": "double", "duration_sec": "double"} | dict.fromkeys(("n_frames", "width", "height", "file_size_bytes", "seed"), "bigint")
MEDIA = ("video", "image")


def read(spark: SparkSession, path: str, *, schema: str | None = None) -> DataFrame:
    """Rows of a JSONL, CSV or Parquet manifest; blank lines count for nothing.

    No file, a line that is no JSON object (named by its number), no rows, and rows without their keys raise.
    """
    try:
        rows = _rows_of(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise ManifestError(f"manifest not found: {path}") from e
        raise
    missing = [c for c in ("sample_id", "experiment") if c not in rows.columns]
    if missing:
        raise ManifestError(f"{path}: no column {missing}")
    if rows.isEmpty():
        raise ManifestError(f"{path}: no rows")
    return rows


def _rows_of(spark: SparkSession, path: str, schema: str | None) -> DataFrame:
    low = path.lower()
    if low.endswith(".csv"):
        return csv_records.table(spark, path)
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    kind = F.schema_of_variant(F.try_parse_json("value"))
    bad = lines.where(F.trim("value") != "").where(~F.coalesce(kind.startswith("OBJECT"), F.lit(False))).agg(F.min(F.struct("line", "value")).alias("x")).first().x
    if bad:
        n = lines.where(F.col("line") <= bad.line).count()
        raise ManifestError(f"{path}:{n}: not a JSON object: {bad.value[:80]}")
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def checked(rows: DataFrame) -> DataFrame:
    """Rows that must name a sample, an experiment, a condition and a path, and whose media are of a known kind; others raise."""
    bad: Column = F.lit(None).cast("string")
    for c in ("sample_id", "experiment", "condition", "media_path"):
        bad = F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(f"{c} is empty")).otherwise(bad)
    bad = F.when(~F.coalesce(F.col("media_type").isin(*MEDIA), F.lit(False)), F.lit("unknown media_type")).otherwise(bad)
    return rows.withColumn("sample_id", F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.col("sample_id")))


def reserved(extra: list[str]) -> None:
    """Extra columns mustn't have a core column's name, nor that of the output."""
    if clash := sorted(set(extra) & {*CORE, "model_output"}):
        raise ManifestError(f"extra columns {clash} have reserved names")


def unique_ids(rows: DataFrame) -> None:
    twice = rows.groupBy("sample_id").count().where("count > 1").orderBy("sample_id").limit(5).collect()
    if twice:
        raise ManifestError(f"sample_id repeats: {[r.sample_id for r in twice]}")


def order_of(columns: list[str]) -> list[str]:
    """Core, then extras by name, then cfg_ by name, then model_output."""
    extra = sorted(c for c in columns if c not in CORE and not c.startswith("cfg_") and c != "model_output")
    return [*CORE, *extra, *sorted(c for c in columns if c.startswith("cfg_")), "model_output"]


def canonical(rows: DataFrame, config: dict[str, object] | None = None) -> DataFrame:
    """All columns in their order: what a row lacks is null, what only the configuration has comes from it, output is blank."""
    out = rows
    for k, v in (config or {}).items():
        if f"cfg_{k}" not in out.columns:
            out = out.withColumn(f"cfg_{k}", F.lit(v))
    for c in CORE:
        if c not in out.columns:
            out = out.withColumn(c, F.element_at(F.split("media_path", "/"), -1) if c == "media_filename" else F.lit(None).cast(KINDS.get(c, "string")))
    if "model_output" not in out.columns:
        out = out.withColumn("model_output", F.lit(""))
    return out.select(*[F.col(f"`{c}`") for c in order_of(out.columns)])


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_file(rows: DataFrame, path: str, *, by: str | None = "sample_id") -> int:
    """Rows in order as one JSONL or CSV file, which appears whole or not at all; written in parts by executors."""
    return one_file.write(rows, str(path), by=by)
