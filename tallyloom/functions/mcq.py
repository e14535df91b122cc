"""Multiple-choice answers in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns, in the order in which they are tried; the last one minds the case.
ANSWER_PATTERNS = (
    r"(?iU)ANSWER\s*[:\-=]\s*\(?\s*([A-D])\b",
    r"(?iU)^\s*\(?([A-D])\)?[\s.:,)-]",
    r"(?iU)\(\s*([A-D])\s*\)",
    r"(?U)\b([A-D])\b",
)
#: Phrases of a refusal.
REFUSAL_PHRASES = (
    "i'm sorry", "i am sorry", "i cannot", "i can't", "i can not", "as an ai", "not able to assist",
    "i apologize", "i apologise", "unable to help", "can't help with that",
)


def parse_answer(text: Column) -> Column:
    """The chosen letter, or null."""
    return F.upper(F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in ANSWER_PATTERNS]))


def is_refusal(text: Column) -> Column:
    said = F.lower(F.coalesce(text, F.lit("")))
    phrase = F.lit(False)
    for p in REFUSAL_PHRASES:
        phrase = phrase | F.contains(said, F.lit(p))
    return phrase & parse_answer(text).isNull()


def mcq_scores(truth: Column, output: Column) -> dict[str, Column]:
    found = parse_answer(output)
    return {
        "correct": F.coalesce(found == F.upper(F.trim(truth)), F.lit(False)).cast("double"),
        "answered": found.isNotNull().cast("double"),
        "refusal": is_refusal(output).cast("double"),
        "predicted_answer": found,
    }
