"""Text metrics as column expressions. Every value is rounded half-even to six places where it is reported."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import distances

ARTICLES = ("a", "an", "the")


def _base_letters() -> tuple[str, str]:
    """Latin letters with marks that decompose to one base letter, and those letters."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _base_letters()
#: Other letters of that range which stay as they are; what else isn't ASCII is decomposed in Python.
_KEPT = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and unicodedata.normalize("NFKD", c) == c)


def normalise(text: Column, strip_articles: bool = True) -> Column:
    """Lower-case words of the full compatibility decomposition, without marks, punctuation or articles, a space between; null gives ''.

    Texts of ASCII and Latin letters with at most marks are done by a table that Catalyst evaluates, others in Python, with equal results.
    """
    words = tokens(text, strip_articles)
    return F.array_join(words, " ")


def tokens(text: Column, strip_articles: bool = True) -> Column:
    """The words of normalise(). It may call Python, so it has to be projected before lambdas go through it."""
    text = F.coalesce(text, F.lit(""))
    plain = F.lower(F.translate(text, _MARKED, _PLAIN))
    native = F.split(F.regexp_replace(plain, r"[^\p{L}\p{N}_]+", " "), " ")
    rest = F.translate(text, _MARKED + _KEPT, _PLAIN)  # ASCII alone if the table covers all; faster than a pattern
    words = F.coalesce(_exact_words(F.when(F.octet_length(rest) != F.length(rest), text)), native)
    gone = ("", *ARTICLES) if strip_articles else ("",)
    return F.filter(words, lambda w: ~w.isin(*gone))


def _words(t: str) -> list[str]:
    import re

    plain = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    return re.sub(r"[^\w\s]", " ", plain).split()


#: Texts that Python holds the words of at once; those of the others of a batch are in Arrow.
AT_ONCE = 64


@F.arrow_udf(ArrayType(StringType()))
def _exact_words(text: pa.Array) -> pa.Array:
    """The words of the full compatibility decomposition; null stays null."""
    kind = pa.list_(pa.string())
    parts = [pa.array([None if t is None else _words(t) for t in text[i : i + AT_ONCE].to_pylist()], kind) for i in range(0, len(text), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.pandas_udf(StringType())
def normalise_exact(text: pd.Series) -> pd.Series:
    """As normalise(), all of it in Python."""
    return text.map(lambda t: " ".join(w for w in _words(t or "") if w not in ARTICLES))


def exact_match(a: Column, b: Column) -> Column:
    return (normalise(a) == normalise(b)).cast("double")


#: Words in common times words in all up to which the former are counted one by one.
ONE_BY_ONE = 20_000


def overlap(a: Column, b: Column) -> Column:
    """The size of the multiset intersection of two arrays of text.

    Words of both are counted one by one where they are few; else both arrays are sorted together, and each word's run is counted.
    """
    both = F.array_intersect(a, b)
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    one_by_one = F.aggregate(both, F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return F.when(F.size(both).cast("bigint") * (F.size(a) + F.size(b)) <= ONE_BY_ONE, one_by_one).otherwise(_sorted_overlap(a, b))


def _sorted_overlap(a: Column, b: Column) -> Column:
    of = lambda xs, side: F.transform(xs, lambda w: F.struct(w.alias("w"), F.lit(side).alias("side")))
    both = F.sort_array(F.concat(of(a, 0), of(b, 1)))
    none = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"))

    def step(seen: Column, x: Column) -> Column:
        same = seen["w"].eqNullSafe(x["w"])
        more = lambda name, side: (F.when(same, seen[name]).otherwise(0) + F.when(x["side"] == side, 1).otherwise(0)).alias(name)
        return F.struct(x["w"].alias("w"), more("a", 0), more("b", 1), (seen["n"] + F.when(same, 0).otherwise(F.least(seen["a"], seen["b"]))).alias("n"))

    return F.aggregate(both, none, step, lambda seen: seen["n"] + F.least(seen["a"], seen["b"]))


def token_f1(ref: Column, hyp: Column) -> Column:
    """Of two token arrays: 1 if both are empty, 0 if one is."""
    n = overlap(ref, hyp)
    return F.when((F.size(ref) == 0) & (F.size(hyp) == 0), 1.0).when(n == 0, 0.0).otherwise(2.0 * n / (F.size(ref) + F.size(hyp)))


def ngrams(words: Column, n: int) -> Column:
    if n < 1:
        raise ValueError("n must be positive")
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def brevity(ref: Column, hyp: Column) -> Column:
    return F.when(F.size(hyp) == 0, 0.0).when(F.size(hyp) > F.size(ref), 1.0).otherwise(F.exp(1.0 - F.size(ref) / F.size(hyp)))


def bleu(ref: Column, hyp: Column, grams: list[tuple[Column, Column]]) -> Column:
    """Smoothed sentence score: orders without n-grams in hyp are skipped, the first is unsmoothed, later ones add one.

    grams: the n-grams of both, by order; columns of an earlier projection, as each is gone through for every element.
    """
    logs, used, none = F.lit(0.0), F.lit(0), F.lit(False)
    for n, (r, h) in enumerate(grams, 1):
        hits, all_ = overlap(r, h), F.size(h)
        more = int(n > 1)
        share = F.try_divide(hits + more, all_ + more)
        logs = logs + F.when((all_ > 0) & (share > 0), F.log(share)).otherwise(0.0)
        used = used + F.when(all_ > 0, 1).otherwise(0)
        none = none | (hits == 0) if n == 1 else none
    empty = (F.size(ref) == 0) | (F.size(hyp) == 0)
    return F.when(empty | none, 0.0).otherwise(F.exp(F.try_divide(logs, used)) * brevity(ref, hyp))


def with_grams(rows: DataFrame, ref: str, hyp: str, max_n: int = 4) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """rows with the n-grams of two token columns as _r<n> and _h<n>, and these columns."""
    out = rows.withColumns({f"_{k}{n}": ngrams(F.col(c), n) for k, c in (("r", ref), ("h", hyp)) for n in range(1, max_n + 1)})
    return out, [(F.col(f"_r{n}"), F.col(f"_h{n}")) for n in range(1, max_n + 1)]


#: Characters of the longer text from which a pair's distance is worked out by bits; the built-in one takes a step for each pair of characters.
LONG = 200


def char_similarity(a: Column, b: Column) -> Column:
    """Of two normalised texts."""
    longest = F.greatest(F.length(a), F.length(b))
    long = longest >= LONG
    edits = F.coalesce(distances.char_edits(F.when(long, a), F.when(long, b)), F.when(~long, F.levenshtein(a, b)))
    return F.when(longest == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - edits / longest))


def word_error_rate(ref: Column, hyp: Column) -> Column:
    """Word edits by the reference's length, not capped."""
    return F.when(F.size(ref) == 0, F.when(F.size(hyp) == 0, 0.0).otherwise(1.0)).otherwise(distances.word_edits(ref, hyp) / F.size(ref))


_word_edits = distances.word_edits


#: What a judge's cell may say.
JUDGE_TRUE = ("1", "true", "yes", "y", "t", "correct", "pass")
JUDGE_FALSE = ("0", "false", "no", "n", "f", "incorrect", "fail")


def judge(cell: Column) -> Column:
    said = F.lower(F.trim(cell.cast("string")))
    return F.when(said.isin(*JUDGE_TRUE), 1.0).when(said.isin(*JUDGE_FALSE), 0.0).otherwise(said.try_cast("double"))


def text_scores(rows: DataFrame, truth: str, output: str, prefix: str = "score_") -> DataFrame:
    """rows with the five metrics. Tokens and n-grams are made once, each in a projection before those that go through them."""
    named = rows.withColumns({"_ref": tokens(F.col(truth)), "_hyp": tokens(F.col(output))})
    named, grams = with_grams(named.withColumns({"_a": F.array_join("_ref", " "), "_b": F.array_join("_hyp", " ")}), "_ref", "_hyp")
    ref, hyp, a, b = (F.col(c) for c in ("_ref", "_hyp", "_a", "_b"))
    out = {"exact_match": (a == b).cast("double"), "token_f1": token_f1(ref, hyp), "bleu": bleu(ref, hyp, grams), "char_similarity": char_similarity(a, b), "wer": word_error_rate(ref, hyp)}
    return named.withColumns({prefix + k: F.bround(v, 6) for k, v in out.items()}).drop("_ref", "_hyp", "_a", "_b", *[f"_{k}{n}" for k in "rh" for n in range(1, 5)])
