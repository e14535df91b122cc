"""Quality rules, in DataFrame functions only: a fixed base rule, then adaptive thresholds.

The thresholds come from quantile sketches for each language and source: counts of a metric's values on a fixed
grid of integers, a bounded number of them for each metric. Such sketches merge by adding counts, and give a
quantile exactly to the grid's step, the same one in every run. A document is rejected where a metric lies far out
for its language and source: more than REACH times the spread between the quartiles above the upper one, the spread
counting as LEAST at least, so that a group in which nearly all values are equal doesn't reject what is only a
little off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .mixing import WORD

REACH = 3
#: Metric -> (steps of its grid to 1, least spread in steps, last cell of the grid). Shares end at 1; means of a word's
#: code points from 1,000 on are in one cell. So a group's sketches hold 1,001 + 10,001 + 1,001 counts at most.
METRICS = {"symbol_share": (1000, 15, 1000), "word_length": (10, 15, 10_000), "dup_line_share": (1000, 150, 1000)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACE = " \t\n\x0b\x0c\r"


def _measured(docs: DataFrame, carry: list[str], text: str, lang: str, source: str) -> tuple[DataFrame, dict[str, str]]:
    """The columns of carry with the counts, the grid values and the group, in one pass over the texts that is written out.

    They have names that clash with none of docs; the names are returned by what they hold.
    """
    what = [*COUNTS, *METRICS, "lang", "source", "t", "lines", "n_lines", "h", "w", "any", "s", "at"]
    name = dict(zip(what, scratch.private(docs, *what)))
    c = {k: F.col(v) for k, v in name.items()}
    rows = docs.select(*carry, F.col(lang).alias(name["lang"]), F.col(source).alias(name["source"]), F.coalesce(F.col(text), F.lit("")).alias(name["t"]))
    rows = rows.withColumn(name["lines"], F.filter(F.split(c["t"], "\n"), lambda x: F.translate(x, _SPACE, "") != ""))
    rows = rows.withColumns({
        name["n_words"]: F.regexp_count(c["t"], F.lit(WORD)).cast("bigint"),
        name["word_chars"]: F.length(F.translate(c["t"], _SPACE, "")).cast("bigint"),
        name["n_symbols"]: (F.length(c["t"]) - F.length(F.translate(c["t"], "#*$%&|<>", ""))).cast("bigint"),
        name["n_lines"]: F.size(c["lines"]).cast("bigint"),
        name["n_dup_lines"]: (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("bigint"),
    })
    rows = _with_repeat_words(rows, name)
    rows = rows.withColumns({name[m]: v for m, v in _grid(name).items()})
    kept = [*carry, *(name[k] for k in (*COUNTS, *METRICS, "lang", "source"))]
    return scratch.stored(rows.select(*kept), "measured"), name


def _with_repeat_words(rows: DataFrame, name: dict[str, str], window: int = 5) -> DataFrame:
    """rows with the words inside windows of five words that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their words' hashes. Only texts in which some window repeats are sorted:
    the repeats' places in order, each adds its window's words up to the next place.
    """
    h, w, some, s, at = (F.col(name[k]) for k in ("h", "w", "any", "s", "at"))
    words = F.filter(F.split(F.col(name["t"]), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    rows = rows.withColumn(name["h"], F.transform(words, lambda x: F.xxhash64(x)))
    places = F.when(F.size(h) >= window, F.sequence(F.lit(1), F.size(h) - (window - 1))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn(name["w"], F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(window)])))
    rows = rows.withColumn(name["any"], F.size(F.array_distinct(w)) < F.size(w))
    rows = rows.withColumn(name["s"], F.when(some, F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, i: (F.get(s, i - 1).h == x.h) | (F.get(s, i + 1).h == x.h)
    rows = rows.withColumn(name["at"], F.when(some, F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x.i))))
    added = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")), lambda a, i: F.struct((a.n + F.least(F.lit(window), i - a.last)).alias("n"), i.alias("last")), lambda a: a.n)
    return rows.withColumn(name["n_repeat_words"], F.coalesce(added, F.lit(0)).cast("bigint"))


def _grid(name: dict[str, str]) -> dict[str, Column]:
    """The metrics on their grids, as integers; of documents without words or lines 0."""
    parts = {"symbol_share": ("n_symbols", "word_chars"), "word_length": ("word_chars", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines")}
    return {m: F.when(F.col(name[of]) > 0, F.least(F.expr(f"`{name[n]}` * {METRICS[m][0]} div `{name[of]}`"), F.lit(METRICS[m][2]))).otherwise(0) for m, (n, of) in parts.items()}


def sketches(measured: DataFrame, group: list[str], metrics: dict[str, str]) -> DataFrame:
    """Per group and metric (its column by its name), how many documents have each grid value: merged by adding n."""
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("bigint").alias("v")) for m, c in metrics.items()]))
    return measured.select(*group, one.alias("x")).groupBy(*group, "x.metric", "x.v").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, group: list[str]) -> DataFrame:
    """Per group, the largest value of each metric that is kept: a column <metric>_most each."""
    by = Window.partitionBy(*group, "metric")
    upto = F.sum("n").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sketch.withColumn("upto", upto).withColumn("all", F.sum("n").over(by))
    quarter = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("v")))
    q = ranked.groupBy(*group, "metric").agg(quarter(1).alias("q1"), quarter(3).alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.element_at(F.create_map(*[F.lit(x) for m, (_, s, _) in METRICS.items() for x in (m, s)]), F.col("metric")))
    q = q.withColumn("most", F.col("q3") + REACH * spread)
    return q.groupBy(*group).agg(*[F.max(F.when(F.col("metric") == m, F.col("most"))).alias(f"{m}_most") for m in METRICS])


def _verdicts(docs: DataFrame, carry: list[str], text: str, lang: str, source: str) -> tuple[DataFrame, dict[str, str], Column, Column]:
    """The measured rows met with their group's thresholds; their names, base_failed and kept."""
    rows, name = _measured(docs, carry, text, lang, source)
    limits = scratch.stored(thresholds(sketches(rows, [name["lang"], name["source"]], {m: name[m] for m in METRICS}), [name["lang"], name["source"]]), "thresholds", 8)
    own = dict(zip(["l", "s", *METRICS], scratch.private(rows, "l", "s", *METRICS)))
    limits = limits.select(F.col(name["lang"]).alias(own["l"]), F.col(name["source"]).alias(own["s"]), *[F.col(f"{m}_most").alias(own[m]) for m in METRICS])
    limits = F.broadcast(limits) if scratch.small_enough(limits, 100_000) else limits
    met = rows.join(limits, F.col(name["lang"]).eqNullSafe(F.col(own["l"])) & F.col(name["source"]).eqNullSafe(F.col(own["s"])), "left")
    failed = (F.col(name["n_words"]) < 10) | (100 * F.col(name["n_repeat_words"]) > 20 * F.col(name["n_words"]))
    far = F.lit(False)
    for m in METRICS:
        far = far | (F.col(name[m]) > F.col(own[m]))
    return met, name, failed, ~failed & ~F.coalesce(far, F.lit(False))


def judged(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (all, if none are named) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    Nulls: a null text has no words and fails the base rule; null lang or source form groups of their own. Repeated rows
    are judged each, ties share a verdict. Columns of docs that have a result's name are replaced, others of any name stay.
    An empty table gives an empty one. Texts of any length are read whole; each is measured once, and the thresholds come from those measures.
    """
    results = [*COUNTS, "base_failed", "kept"]
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in results]
    met, name, failed, kept = _verdicts(docs, carry, text, lang, source)
    return met.select(*carry, *[F.col(name[c]).alias(c) for c in COUNTS], failed.alias("base_failed"), kept.alias("kept"))


def kept_documents(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that are kept, with its columns as they are; nulls and ties as in judged()."""
    met, _, _, kept = _verdicts(docs, docs.columns, text, lang, source)
    return met.where(kept).select(*docs.columns)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    return judged(scratch.table(spark, sf_dir, "documents"), carry=["doc_id"])


OP9_SQL = r"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select r, doc_id, lang, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
m as (select r, doc_id, lang, source, len(ws)::bigint as n_words, len(array_to_string(ws, ''))::bigint as word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls) as n_lines from w),
g as (select r, i, hash(ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4]) as h from (select r, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
p as (select r, i from (select r, i, count(*) over (partition by r, h) as n from g) where n > 1),
q as (select r, sum(least(5, i - before))::bigint as n_repeat_words from (select r, i, coalesce(lag(i) over (partition by r order by i), i - 5) as before from p) group by r),
a as (select m.*, coalesce(q.n_repeat_words, 0)::bigint as n_repeat_words, case when n_words > 0 then n_symbols * 1000 // word_chars else 0 end as v1, case when n_words > 0 then least(word_chars * 10 // n_words, 10000) else 0 end as v2,
  case when n_lines > 0 then n_dup_lines * 1000 // n_lines else 0 end as v3 from m left join q using (r)),
z as (select lang as l, source as s, quantile_disc(v1, 0.75) + 3 * greatest(quantile_disc(v1, 0.75) - quantile_disc(v1, 0.25), 15) as m1, quantile_disc(v2, 0.75) + 3 * greatest(quantile_disc(v2, 0.75) - quantile_disc(v2, 0.25), 15) as m2,
  quantile_disc(v3, 0.75) + 3 * greatest(quantile_disc(v3, 0.75) - quantile_disc(v3, 0.25), 150) as m3 from a group by lang, source),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from a join z on lang is not distinct from l and source is not distinct from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and v1 <= m1 and v2 <= m2 and v3 <= m3 as kept from b
"""
