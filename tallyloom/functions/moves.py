"""Move lists: parsing as columns, and alignment in one Arrow UDF."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from . import distances

MOVE = "struct<move_num:bigint,color:string,from:string,to:string>"
#: Fixed patterns of a move in a table, in a compact cell, and in a model's text from the most explicit on.
TABLE_ROW = r"(?im)^[ \t]*(\d+)\s+(white|black)\s+([a-h][1-8])\s+([a-h][1-8])\s*$"
COMPACT = r"(?i)(\d+)\s+(white|black)\s+([a-h][1-8])\s+([a-h][1-8])"
_SQUARES = r"(?:[a-z]+\s+)?([a-h][1-8])\s*(?:->|to|-|—|\s)?\s*([a-h][1-8])"
MODEL_MOVE = r"(?i)move\s+(\d+)\s*[:\-.]?\s*(white|black)\s+" + _SQUARES
MODEL_LIST = r"(?i)(\d+)\s*[.)]\s*(white|black)\s+" + _SQUARES
MODEL_BARE = r"(?i)(white|black)\s+" + _SQUARES


#: What stands around a match and between its groups; where a text has one of them, a third is put there, which no pattern tells from it.
_EDGE, _BETWEEN, _OTHER = "\x01", "\x02", "\x03"


def _text(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains(_EDGE) | t.contains(_BETWEEN), F.translate(t, _EDGE + _BETWEEN, _OTHER * 2)).otherwise(t)


def _marked(text: Column, pattern: str, groups: int = 4) -> Column:
    """text with a pattern's groups marked at each match, by one pass over it."""
    return F.regexp_replace(text, pattern, _EDGE + _BETWEEN.join(f"${k}" for k in range(1, groups + 1)) + _EDGE)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _found(marked: Column, numbered: bool = True) -> Column:
    """The matches of a marked text as moves; without numbers they count from one."""
    groups = F.transform(F.filter(F.split(marked, _EDGE), lambda x, i: i % 2 == 1), lambda x: F.split(x, _BETWEEN))
    k = 1 if numbered else 0
    number = (lambda x, i: x[0].try_cast("bigint")) if numbered else (lambda x, i: (i + 1).cast("bigint"))
    # Patterns know two colours; initcap would look for the words of each one by itself, which takes longer than the pattern.
    return F.transform(groups, lambda x, i: F.struct(number(x, i).alias("move_num"), F.when(F.lower(x[k]) == "white", "White").otherwise("Black").alias("color"), F.lower(x[k + 1]).alias("from"), F.lower(x[k + 2]).alias("to")))


def parse_transcript(text: Column, last_move: int | None = None) -> Column:
    """The moves of a table or, if it has none, of a compact cell; by number, white first, else as they stand."""
    t = _text(text)
    rows = _found(_once(_marked(t, TABLE_ROW), lambda x: F.when(x.contains(_EDGE), x).otherwise(_marked(t, COMPACT))))
    if last_move is not None:
        rows = F.filter(rows, lambda m: m["move_num"] <= last_move)
    keyed = F.transform(rows, lambda m, i: F.struct(m["move_num"].alias("k"), (m["color"] != "White").alias("black"), i.alias("i"), m.alias("m")))
    return F.transform(F.sort_array(keyed), lambda x: x["m"])


def parse_model_output(text: Column) -> Column:
    """The moves of the most explicit pattern that occurs; bare moves are numbered in order."""
    t = _text(text)
    bare = _found(_marked(t, MODEL_BARE, 3), False)
    listed = _once(_marked(t, MODEL_LIST), lambda x: F.when(x.contains(_EDGE), _found(x)).otherwise(bare))
    return _once(_marked(t, MODEL_MOVE), lambda x: F.when(x.contains(_EDGE), _found(x)).otherwise(listed))


def keys(moves: Column) -> Column:
    return F.transform(moves, lambda m: F.concat_ws("|", m["color"], m["from"], m["to"]))


def strict(truth: Column, found: Column) -> Column:
    """The share of truth that found repeats from the start without a fault; of key arrays."""
    same = F.slice(F.zip_with(truth, found, lambda a, b: F.coalesce(a == b, F.lit(False))), 1, F.size(truth))
    first = F.array_position(same, F.lit(False))
    good = F.when(first > 0, first - 1).otherwise(F.size(truth))
    return F.when(F.size(truth) == 0, 0.0).otherwise(good / F.size(truth))


def aligned(truth: list[str], found: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as index pairs. Walking back, equal keys pair up; else a row up wins ties."""
    return distances.common(truth, found)


def _shares(truth: Sequence[Hashable], found: Sequence[Hashable]) -> tuple[float, float, int]:
    if not truth:
        return 0.0, 0.0, 0
    at = [i for i, _ in distances.common(truth, found)]
    in_runs = sum((k > 0 and at[k - 1] == i - 1) or (k + 1 < len(at) and at[k + 1] == i + 1) for k, i in enumerate(at))
    return len(at) / len(truth), in_runs / len(truth), len(at)


@F.arrow_udf(StructType().add("loose", DoubleType()).add("hybrid", DoubleType()).add("matched", LongType()))
def alignment(truth: pa.Array, found: pa.Array) -> pa.Array:
    """Of key arrays: the share aligned, the share in runs of two or more neighbours in truth, and how many are aligned."""
    rows = [_shares(t or [], f or []) for t, f in distances.numbered(truth, found)]
    loose, hybrid, matched = zip(*rows) if rows else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(loose, pa.float64()), pa.array(hybrid, pa.float64()), pa.array(matched, pa.int64())], names=["loose", "hybrid", "matched"])


def move_scores(rows: DataFrame, truth_text: str, output: str, half_moves: str | None = None, prefix: str = "score_") -> DataFrame:
    """rows with the six metrics. Truth is cut to half_moves (a number as text or not; blank for all)."""
    truth = parse_transcript(F.col(truth_text))
    if half_moves is not None:
        n = F.col(half_moves).cast("string").try_cast("double").cast("int")
        truth = F.when(n.isNull(), truth).otherwise(F.slice(truth, F.lit(1), F.greatest(n, F.lit(0))))
    named = rows.withColumns({"_t": keys(truth), "_f": keys(parse_model_output(F.col(output)))})
    named = named.withColumn("_al", alignment("_t", "_f"))
    out = {
        "strict": F.bround(strict(F.col("_t"), F.col("_f")), 6), "loose": F.bround("_al.loose", 6), "hybrid": F.bround("_al.hybrid", 6),
        "moves_matched": F.col("_al.matched"), "moves_expected": F.size("_t").cast("bigint"), "moves_predicted": F.size("_f").cast("bigint"),
    }
    return named.withColumns({prefix + k: v for k, v in out.items()}).drop("_t", "_f", "_al")
