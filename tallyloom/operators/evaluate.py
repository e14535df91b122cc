"""Scoring manifests and summing the scores up."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EvalError
from ..functions import mcq, moves, text
from ..storage import stored

#: A scorer adds its score_ columns to rows with ground_truth and model_output, which are never null.
Scorer = Callable[[DataFrame], DataFrame]


def _mcq(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"score_{k}": v for k, v in mcq.mcq_scores(F.col("ground_truth"), F.col("model_output")).items()})


def _asl(rows: DataFrame) -> DataFrame:
    judges = {f"score_{k}": text.judge(F.col(k)) for k in ("judge_strict", "judge_loose") if k in rows.columns}
    return text.text_scores(rows, "ground_truth", "model_output").withColumns(judges)


def _chess(rows: DataFrame) -> DataFrame:
    return moves.move_scores(rows, "ground_truth", "model_output", "n_half_moves" if "n_half_moves" in rows.columns else None)


SCORERS: dict[str, Scorer] = {"wbw_mcq": _mcq, "asl": _asl, "chess": _chess}


def register_scorer(experiment: str, scorer: Scorer) -> None:
    SCORERS[experiment] = scorer


def score(rows: DataFrame, experiments: list[str] | None = None) -> DataFrame:
    """rows with score_<metric> of their experiment, null where the experiment has no such metric.

    Rows are scored where they stand, an experiment at a time; a blank or unknown experiment raises. Blank output is scored too.
    """
    if "model_output" not in rows.columns:
        raise EvalError("rows have no model_output: add the model's answers in that column")
    names = experiments or list(SCORERS)
    known = F.coalesce(F.col("experiment").isin(*names), F.lit(False))
    odd = F.raise_error(F.concat(F.lit("no scorer for experiment "), F.coalesce("experiment", F.lit("null"))))
    told = rows.withColumns({"experiment": F.when(known, F.col("experiment")).otherwise(odd)} | {c: F.coalesce(c, F.lit("")) for c in ("ground_truth", "model_output")})
    parts = [SCORERS[name](told.where(F.col("experiment") == name)) for name in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


#: Of each experiment: its metrics in the order of a report, and the one that stands for all.
METRICS: dict[str, tuple[str, ...]] = {
    "wbw_mcq": ("correct", "answered", "refusal"),
    "asl": ("exact_match", "token_f1", "bleu", "char_similarity", "wer"),
    "chess": ("strict", "loose", "hybrid", "moves_matched", "moves_expected", "moves_predicted"),
}
PRIMARY = {"wbw_mcq": "correct", "asl": "token_f1", "chess": "loose"}
#: What scoring adds that isn't a metric.
DETAILS = {"wbw_mcq": ("predicted_answer",)}


def default_groups(rows: DataFrame, run: bool = True) -> list[str]:
    return [c for c in ("experiment", "condition", "model", *(("run_id",) if run else ())) if c in rows.columns]


def groups_of(rows: DataFrame, by: list[str] | None = None) -> list[str]:
    """The columns to sum up by: those that are named, which must be there, or the usual ones."""
    if not by:
        return default_groups(rows)
    if missing := [c for c in by if c not in rows.columns]:
        raise EvalError(f"no such columns: {missing}")
    return list(by)


def metrics_of(rows: DataFrame, *, all_numbers: bool = False) -> list[str]:
    """The score_ columns, in their order, whose values are numbers. Of text some value must be one, or, for a table that was
    read back, all that aren't blank; truth values are none. Text columns are looked through in one pass."""
    named = [(c, t) for c, t in rows.dtypes if c.startswith("score_")]
    numeric = {c for c, t in named if t not in ("string", "boolean") and not t.startswith(("array", "struct", "map", "void"))}
    texts = [c for c, t in named if t == "string"]
    if texts:
        blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
        r = rows.agg(*[x for c in texts for x in (F.count_if(~blank(c)).alias(f"{c}_n"), F.count_if(~blank(c) & number(F.trim(c)).isNotNull()).alias(f"{c}_k"))]).first()
        numeric |= {c for c in texts if r[f"{c}_k"] and (not all_numbers or r[f"{c}_k"] == r[f"{c}_n"])}
    return [c for c, _ in named if c in numeric]


def experiments_of(rows: DataFrame) -> DataFrame:
    """One row: the experiments in order, and how many conditions there are."""
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return rows.agg(F.array_sort(F.collect_set(some("experiment"))).alias("experiments"), F.countDistinct(some("condition")).alias("conditions"))


def number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def summarise(rows: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """Per group its rows and each metric's mean over what is a number, half-even to six places, by the groups in order."""
    missing = [c for c in groups if c not in rows.columns]
    if missing:
        raise EvalError(f"no such columns: {missing}")
    means = [F.bround(F.avg(number(F.col(m))), 6).alias(m) for m in metrics]
    return rows.groupBy(*[F.col(g).cast("string").alias(g) for g in groups]).agg(F.count("*").alias("n"), *means).orderBy(*groups)


def overall(rows: DataFrame, metric: str) -> DataFrame:
    return rows.agg(F.bround(F.avg(number(F.col(metric))), 6).alias(metric))


def bars(summary: DataFrame, metrics: list[str]) -> DataFrame:
    """Each metric as a percentage of its largest value; the summary is a row per group."""
    most = summary.agg(*[F.max(m).alias(f"_{m}") for m in metrics])
    out = summary.join(F.broadcast(most), how="cross")  # one row
    return out.select(*summary.columns, *[F.bround(F.coalesce(100 * F.try_divide(F.col(m), F.col(f"_{m}")), F.lit(0.0)), 2).alias(f"{m}_bar") for m in metrics])


def missing_outputs(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("model_output", F.lit(""))) == "").alias("missing"))


def upper_median(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Least, upper median and most: of n values in order, the one at n div 2 from 0. Values are counted first, so a group is as small as its distinct values."""
    from pyspark.sql import Window

    counts = rows.groupBy(*groups, value).agg(F.count("*").alias("k"))
    by = Window.partitionBy(*groups)
    ranked = counts.withColumn("upto", F.sum("k").over(by.orderBy(value))).withColumn("n", F.sum("k").over(by))
    return ranked.groupBy(*groups).agg(F.min(value).alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col(value))).alias("median"), F.max(value).alias("most"))


def text_summary(rows: DataFrame, summary: DataFrame, groups: list[str], metrics: list[str]) -> str:
    """What was scored, in lines: rows and experiments, blank outputs, each metric's mean, and the summary as a table."""
    from ..plans.report import text_table

    missing = missing_outputs(rows).first()
    names = experiments_of(rows).first().experiments
    out = [f"Scored {missing.n} row(s) across {', '.join(names) or '—'}"]
    if missing.missing:
        out.append(f"  {missing.missing} row(s) had an empty model_output (scored as a wrong answer, not skipped)")
    if metrics:
        means = rows.agg(*[F.avg(number(F.col(m))).alias(m) for m in metrics]).first()
        out.append("  overall: " + "  ".join(f"{m.removeprefix('score_')}={means[m]:.4f}" for m in metrics if means[m] is not None))
    return "\n".join([*out, "", text_table(summary.select(*groups, "n", *metrics))])


def evaluate(spark: SparkSession, path: str, output: str | None = None, *, run_dir: str | None = None, by: list[str] | None = None) -> dict:
    """Score a manifest file and write scored and summary beside it, or into output, in the manifest's format.

    Ground truths that the manifest names as files are read from run_dir, by default the manifest's folder. Returns the scored rows, the
    summary, metrics, groups and the paths.
    """
    from ..sources import manifest
    from . import plans

    rows = manifest.read(spark, path)
    if "model_output" not in rows.columns:
        raise EvalError(f"{path}: no model_output column: add the model's answers in that column")
    for c in ("ground_truth", "ground_truth_path", "condition"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit("" if c != "condition" else None).cast("string"))
    base = run_dir or os.path.dirname(path) or "."
    groups = groups_of(rows, by)
    names = rows.select("ground_truth_path").where("trim(coalesce(ground_truth_path, '')) <> ''")
    if names.isEmpty():
        told = rows.withColumn("truth", F.coalesce("ground_truth", F.lit("")))
    else:
        told = plans.ground_truth(rows, truth_files(spark, base))
    known = [r[0] for r in rows.select("experiment").distinct().limit(len(SCORERS) + 1).collect()]
    if odd := sorted(str(x) for x in known if x not in SCORERS):
        raise EvalError(f"{path}: no scorer for experiment {odd}, there are {sorted(SCORERS)}")
    scored = score(told.withColumn("_cell", F.col("ground_truth")).withColumn("ground_truth", F.col("truth")).drop("truth"), known)
    scored = stored(scored.withColumn("ground_truth", F.col("_cell")).drop("_cell"), "scored")
    metrics = metrics_of(scored)
    summary = summarise(scored, groups, metrics)
    target, end = output or os.path.dirname(path) or ".", ".csv" if path.lower().endswith(".csv") else ".jsonl"
    paths = [os.path.join(target, f"{n}{end}") for n in ("scored", "summary")]
    manifest.write_file(scored, paths[0])
    manifest.write_file(summary, paths[1], by=None)
    return {"rows": scored, "summary": summary, "metrics": metrics, "groups": groups, "paths": paths}


def truth_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, relative to folder, and content of the files of its ground_truth/."""
    files = spark.read.text(f"{folder}/ground_truth", wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value")
    return files.select(F.concat(F.lit("ground_truth/"), F.url_decode(F.regexp_extract("p", "[^/]*$", 0))).alias("path"), F.col("value").alias("content"))
