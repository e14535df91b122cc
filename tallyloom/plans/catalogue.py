"""Queries over the driver's tables, each an operator bound to them, and the same in SQL.

The tables aren't manifests, so rows are derived by rules that both engines express. Texts that meet a distance
which is quadratic in their length are conversation turns, which are short.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import items, mcq, moves, text
from ..operators import chess, evaluate, plans, sampling
from . import config, report

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def named(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return named


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Multiple choice: outputs of eight shapes over events.

_LETTER = "chr(cast(65 + {} % 4 as int))"
_OUTPUT = """case event_id % 8 when 0 then 'ANSWER: ' || chr(cast(65 + event_id % 3 as int)) when 1 then chr(cast(97 + event_id % 4 as int)) || ') because' when 2 then 'it is (' || chr(cast(65 + event_id % 5 as int)) || ').'
 when 3 then 'I think ' || chr(cast(65 + event_id % 6 as int)) || ' is right' when 4 then 'I''m sorry, I cannot help with that.' when 5 then 'I am sorry, but ANSWER - B' when 6 then 'a dog barks' else '' end"""
_EVENTS = f"select cast(event_id as string) as sample_id, 'wbw_mcq' as experiment, event_type as condition, chr(cast(65 + user_id % 4 as int)) as ground_truth, {_OUTPUT} as model_output"
_EVENTS_SQL = f"e as ({_EVENTS.replace('as string', 'as varchar')} from events)"
_PARSED_SQL = r"""p as (select *, upper(coalesce(nullif(regexp_extract(model_output, '(?i)ANSWER\s*[:\-=]\s*\(?\s*([A-D])\b', 1), ''), nullif(regexp_extract(model_output, '(?i)^\s*\(?([A-D])\)?[\s.:,)-]', 1), ''),
 nullif(regexp_extract(model_output, '(?i)\(\s*([A-D])\s*\)', 1), ''), nullif(regexp_extract(model_output, '\b([A-D])\b', 1), ''))) as a from e),
 m as (select *, coalesce(a = ground_truth, false)::int::double as correct, (a is not null)::int::double as answered,
 (regexp_matches(lower(model_output), 'i''m sorry|i am sorry|i cannot|i can''t|i can not|as an ai|not able to assist|i apologize|i apologise|unable to help|can''t help with that') and a is null)::int::double as refusal from p)"""


def _mcq_rows(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").selectExpr(*[x.strip() for x in ("cast(event_id as string) as sample_id", "'wbw_mcq' as experiment", "event_type as condition", "chr(cast(65 + user_id % 4 as int)) as ground_truth", f"{_OUTPUT} as model_output")])


@query(f"with {_EVENTS_SQL}, {_PARSED_SQL} select experiment, condition, count(*) as n, round_even(avg(correct), 6) as score_correct, round_even(avg(answered), 6) as score_answered, round_even(avg(refusal), 6) as score_refusal from m group by all")
def mcq_eval_summary(spark, d):
    rows = evaluate.score(_mcq_rows(spark, d), ["wbw_mcq"])
    return evaluate.summarise(rows, ["experiment", "condition"], evaluate.metrics_of(rows))


@query(f"with {_EVENTS_SQL}, {_PARSED_SQL} select sample_id, a as predicted from m")
def mcq_parse_answer(spark, d):
    return _mcq_rows(spark, d).select("sample_id", mcq.parse_answer(F.col("model_output")).alias("predicted"))


@query(f"with {_EVENTS_SQL}, {_PARSED_SQL} select sample_id, refusal = 1 as refused from m")
def mcq_refusal(spark, d):
    return _mcq_rows(spark, d).select("sample_id", mcq.is_refusal(F.col("model_output")).alias("refused"))


@query(f"with {_EVENTS_SQL} select count(*) as n, count(*) filter (where trim(model_output) = '') as missing from e")
def missing_output_count(spark, d):
    return evaluate.missing_outputs(_mcq_rows(spark, d))


@query("select event_type as grp, count(*) as n, round_even(avg(case when event_id % 7 = 0 then null else value end), 6) as v from events group by 1")
def summarise_mean(spark, d):
    rows = _t(spark, d, "events").selectExpr("event_type as grp", "case when event_id % 7 = 0 then '' else cast(value as string) end as v")
    return evaluate.summarise(rows, ["grp"], ["v"])


@query("select round_even(avg(value), 6) as value from events")
def summarise_overall(spark, d):
    return evaluate.overall(_t(spark, d, "events"), "value")


@query("with s as (select l_returnflag, l_linestatus, count(*) as n, round_even(avg(l_quantity), 6) as l_quantity, round_even(avg(l_discount), 6) as l_discount from lineitem group by all) select *, round_even(100 * l_quantity / (select max(l_quantity) from s), 2) as l_quantity_bar, round_even(100 * l_discount / (select max(l_discount) from s), 2) as l_discount_bar from s")
def metric_maxima_bars(spark, d):
    m = ["l_quantity", "l_discount"]
    return evaluate.bars(evaluate.summarise(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], m), m)


@query("select source, min(n_chars) as least, list_sort(list(n_chars))[count(*) // 2 + 1] as median, max(n_chars) as most from documents group by source")
def upper_median(spark, d):
    return evaluate.upper_median(_t(spark, d, "documents"), ["source"], "n_chars")


# Text metrics.

_NORM = r"list_filter(string_split(regexp_replace(lower(strip_accents(coalesce({}, ''))), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w not in ('', 'a', 'an', 'the'))"
_PAIRS_SQL = f"c as (select x.conv_id, x.turn, x.role, x.text as ref_text, y.text as hyp_text, {_NORM.format('x.text')} as r, {_NORM.format('y.text')} as h from conversations x join conversations y on x.conv_id = y.conv_id and y.turn = x.turn + 1)"
_OVER = "coalesce(list_sum(list_transform(list_distinct(list_intersect({r}, {h})), lambda w: least(len(list_filter({r}, lambda v: v = w)), len(list_filter({h}, lambda v: v = w))))), 0)"
_F1 = f"case when len(r) = 0 and len(h) = 0 then 1.0 when {_OVER.format(r='r', h='h')} = 0 then 0.0 else 2.0 * {_OVER.format(r='r', h='h')} / (len(r) + len(h)) end"
_GRAMS = "list_transform(range(1, len({x}) - n + 2), lambda i: array_to_string({x}[i : i + n - 1], ' '))"
_BLEU_SQL = f"""g as (select conv_id, turn, n, {_GRAMS.format(x='r')} as rg, {_GRAMS.format(x='h')} as hg from c, range(1, 5) as z(n)),
 o as (select conv_id, turn, n, {_OVER.format(r='rg', h='hg')} as hits, len(hg) as total from g),
 b as (select conv_id, turn, exp(avg(case when total = 0 then null when n = 1 then ln(case when hits = 0 then 1 else hits / total end) else ln((hits + 1) / (total + 1)) end)) as p, max(case when n = 1 and hits = 0 then 1 else 0 end) as none from o group by all)"""
_BLEU = "case when len(r) = 0 or len(h) = 0 or none = 1 then 0.0 else p * (case when len(h) > len(r) then 1.0 else exp(1.0 - len(r) / len(h)) end) end"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp_text"))
    return c.select("conv_id", "turn", "role", F.col("text").alias("ref_text")).join(after, ["conv_id", "turn"]).withColumns({"r": text.tokens(F.col("ref_text")), "h": text.tokens(F.col("hyp_text"))})


@query(f"select doc_id, array_to_string({_NORM.format('text')}, ' ') as norm from documents")
def text_normalise(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.normalise(F.col("text")).alias("norm"))


@query(f"select doc_id, len({_NORM.format('text')})::bigint as n_tokens, len(list_distinct({_NORM.format('text')}))::bigint as n_distinct from documents")
def text_tokens(spark, d):
    t = _t(spark, d, "documents").withColumn("t", text.tokens(F.col("text")))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


@query(f"with {_PAIRS_SQL} select conv_id, turn, (r = h)::int::double as em from c")
def text_exact_match(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", text.exact_match(F.col("ref_text"), F.col("hyp_text")).alias("em"))


@query(f"with {_PAIRS_SQL} select conv_id, turn, round_even(({_F1})::double, 6) as f1 from c")
def text_token_f1(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.bround(text.token_f1(F.col("r"), F.col("h")), 6).alias("f1"))


@query(f"with {_PAIRS_SQL}, {_BLEU_SQL} select c.conv_id, c.turn, round_even(({_BLEU})::double, 6) as bleu from c join b using (conv_id, turn)")
def text_bleu(spark, d):
    rows, grams = text.with_grams(_pairs(spark, d), "r", "h")
    return rows.select("conv_id", "turn", F.bround(text.bleu(F.col("r"), F.col("h"), grams), 6).alias("bleu"))


# The distance goes by bytes, so a pair's characters are told by ASCII codes: exact for pairs of fewer than 128 different ones.
_CODED = """z as (select conv_id, turn, array_to_string(r, ' ') as a, array_to_string(h, ' ') as b from c), y as (select *, list_distinct(string_split(a || b, '')) as v from z),
 x as (select conv_id, turn, length(a) as la, length(b) as lb, array_to_string(list_transform(string_split(a, ''), lambda g: chr(list_position(v, g)::int)), '') as a, array_to_string(list_transform(string_split(b, ''), lambda g: chr(list_position(v, g)::int)), '') as b from y)"""


@query(f"with {_PAIRS_SQL}, {_CODED} select conv_id, turn, round_even(case when la + lb = 0 then 1.0 else greatest(0.0, 1.0 - levenshtein(case when la = 0 then '' else a end, case when lb = 0 then '' else b end) / greatest(la, lb)) end::double, 6) as sim from x")
def text_char_similarity(spark, d):
    """Of all pairs, by characters."""
    rows = _pairs(spark, d).withColumns({"a": F.array_join("r", " "), "b": F.array_join("h", " ")})
    return rows.select("conv_id", "turn", F.bround(text.char_similarity(F.col("a"), F.col("b")), 6).alias("sim"))


# The table of distances a row at a time: steps down and across the diagonal, then insertions as a running minimum.
_WER_SQL = f"""with recursive {_PAIRS_SQL}, q as materialized (select row_number() over () as id, * from c),
 rw as materialized (select id, unnest(r) as w, generate_subscripts(r, 1) as i from q), hw as materialized (select id, unnest(h) as w, generate_subscripts(h, 1) as j from q),
 cells as (select id, 0 as i, unnest(range(0, len(h) + 1)) as j, unnest(range(0, len(h) + 1)) as v from q
  union all select id, i, j, j + min(base - j) over (partition by id order by j) as v from
  (select cells.id, cells.i + 1 as i, cells.j, least(v + 1, coalesce(lag(v) over (partition by cells.id order by cells.j) + (rw.w <> hw.w)::int, v + 1)) as base from cells join rw on rw.id = cells.id and rw.i = cells.i + 1 left join hw on hw.id = cells.id and hw.j = cells.j))"""


@query(f"{_WER_SQL} select conv_id, turn, round_even((case when len(r) = 0 then least(len(h), 1) else v / len(r) end)::double, 6) as wer from cells join q on q.id = cells.id and i = len(r) and j = len(h)")
def text_wer(spark, d):
    """Of whole turns."""
    return _pairs(spark, d).select("conv_id", "turn", F.bround(text.word_error_rate(F.col("r"), F.col("h")), 6).alias("wer"))


@query(f"with {_PAIRS_SQL}, {_BLEU_SQL} select role as condition, count(*) as n, round_even(avg(round_even((r = h)::int::double, 6)), 6) as score_exact_match, round_even(avg(round_even(({_F1})::double, 6)), 6) as score_token_f1, round_even(avg(round_even(({_BLEU})::double, 6)), 6) as score_bleu from c join b using (conv_id, turn) group by role")
def asl_eval_summary(spark, d):
    p = _pairs(spark, d)
    rows = p.select(F.lit("asl").alias("experiment"), F.col("role").alias("condition"), F.col("ref_text").alias("ground_truth"), F.col("hyp_text").alias("model_output"))
    return evaluate.summarise(evaluate.score(rows, ["asl"]), ["condition"], ["score_exact_match", "score_token_f1", "score_bleu"])


_CELL = "case doc_id % 9 when 0 then ' Yes ' when 1 then 'NO' when 2 then '0.75' when 3 then 'correct' when 4 then null when 5 then '' when 6 then 'maybe' when 7 then 'n/a ' else 'true' end"


@query(f"with x as (select doc_id, lower(trim({_CELL})) as s from labels) select doc_id, case when s in ('1','true','yes','y','t','correct','pass') then 1.0 when s in ('0','false','no','n','f','incorrect','fail') then 0.0 else try_cast(s as double) end::double as judge from x")
def judge_parse(spark, d):
    return _t(spark, d, "labels").select("doc_id", text.judge(F.expr(_CELL)).alias("judge"))


# Moves: an order's lines as plies.

_SQ = "chr(cast(97 + {a} % 8 as int)) || cast(1 + {b} % 8 as {t})"
_CELLS = {k: "cast((l_linenumber + 1) div 2 as string) || ' ' || case when l_linenumber % 2 = 1 then 'White' else 'Black' end || ' ' || {} || ' ' || {}".format(_SQ.format(a="l_partkey", b="l_suppkey", t="string"), _SQ.format(a="l_suppkey", b="l_partkey", t="string")) for k in ("cell",)}["cell"]
_MODEL = "case when l_linenumber % 5 = 0 then 'no idea' else 'Move ' || cast((l_linenumber + 1) div 2 as string) || ': ' || case when l_linenumber % 2 = 1 then 'White' else 'black' end || ' Pawn ' || {} || ' -> ' || {} end".format(_SQ.format(a="l_partkey", b="l_suppkey", t="string"), _SQ.format(a="l_suppkey", b="(l_partkey + (case when l_linenumber % 4 = 0 then 1 else 0 end))", t="string"))
_duck = lambda s: s.replace(" div ", " // ").replace("as string", "as varchar")
_LINES_SQL = f"l as (select l_orderkey, string_agg({_duck(_CELLS)}, '; ' order by l_linenumber, l_partkey, l_suppkey) as compact, string_agg({_duck(_MODEL)}, chr(10) order by l_linenumber, l_partkey, l_suppkey) as said, string_agg({_duck(_CELLS)}, chr(10) order by l_linenumber, l_partkey, l_suppkey) as tab from lineitem group by l_orderkey)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    # An order's lines are few, so they are dealt out as they are: gathered before that, they would be sorted twice, and their cells made one by one.
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(_CELLS).alias("cell"), F.expr(_MODEL).alias("said")).repartition("l_orderkey")
    rows = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "cell", "said"))).alias("x"))
    joined = lambda k, sep: F.array_join(F.transform("x", lambda y: y[k]), sep)
    return rows.select("l_orderkey", joined("cell", "; ").alias("compact"), joined("said", "\n").alias("said"), joined("cell", "\n").alias("tab"))


def _flat(rows: DataFrame, m) -> DataFrame:
    return rows.select("l_orderkey", F.posexplode(m).alias("i", "m")).select("l_orderkey", F.col("i").cast("bigint").alias("i"), "m.move_num", "m.color", F.col("m.from").alias("src"), F.col("m.to").alias("dst"))


def _moves_sql(col: str, pattern: str) -> str:
    e = lambda k: f"unnest(regexp_extract_all({col}, '{pattern}', {k}))"
    return f"""with {_LINES_SQL}, x as (select l_orderkey, {e(1)}::bigint as move_num, {e(2)} as c, {e(3)} as src, {e(4)} as dst, generate_subscripts(regexp_extract_all({col}, '{pattern}', 1), 1) as k from l)
 select l_orderkey, row_number() over (partition by l_orderkey order by {{order}}) - 1 as i, move_num, upper(c[1]) || lower(c[2:]) as color, src, dst from x"""


_COMPACT_SQL = _moves_sql("compact", r"(\d+)\s+(White|Black)\s+([a-h][1-8])\s+([a-h][1-8])").format(order="move_num, c <> 'White', k")


@query(_COMPACT_SQL)
def moves_parse_compact(spark, d):
    return _flat(_orders(spark, d), moves.parse_transcript(F.col("compact")))


@query(_COMPACT_SQL)
def moves_parse_table(spark, d):
    return _flat(_orders(spark, d), moves.parse_transcript(F.col("tab")))


@query(_moves_sql("said", r"(?i)move\s+(\d+)\s*[:\-.]?\s*(white|black)\s+(?:[a-z]+\s+)?([a-h][1-8])\s*(?:->|to|-|—|\s)?\s*([a-h][1-8])").format(order="k"))
def moves_parse_model(spark, d):
    return _flat(_orders(spark, d), moves.parse_model_output(F.col("said")))


@query(f"""with t as ({_COMPACT_SQL}), p as ({QUERIES and SQL['moves_parse_model']}), j as (select t.l_orderkey, t.i, coalesce(t.color = p.color and t.src = p.src and t.dst = p.dst, false) as ok from t left join p on t.l_orderkey = p.l_orderkey and t.i = p.i)
 select l_orderkey, round_even(coalesce(min(i) filter (where not ok), count(*)) / count(*), 6) as strict from j group by l_orderkey""")
def moves_strict(spark, d):
    rows = _orders(spark, d).select("l_orderkey", moves.keys(moves.parse_transcript(F.col("compact"))).alias("t"), moves.keys(moves.parse_model_output(F.col("said"))).alias("f"))
    return rows.select("l_orderkey", F.bround(moves.strict(F.col("t"), F.col("f")), 6).alias("strict"))


# The table of common lengths row by row, then the way back from its last cell.
_ALIGNED_SQL = f"""with recursive t as ({_COMPACT_SQL}), p as ({QUERIES and SQL['moves_parse_model']}),
 a as (select l_orderkey, list(concat_ws('|', color, src, dst) order by i) as t from t group by l_orderkey), b as (select l_orderkey, list(concat_ws('|', color, src, dst) order by i) as f from p group by l_orderkey),
 o as (select l_orderkey, t, coalesce(f, []::varchar[]) as f from a left join b using (l_orderkey)),
 grid as (select l_orderkey, t, f, 0 as n, list_transform(range(0, len(f) + 1), lambda j: 0::bigint) as prior, [list_transform(range(0, len(f) + 1), lambda j: 0::bigint)] as tab from o
  union all select l_orderkey, t, f, n + 1, new, list_append(tab, new) from
  (select *, list_prepend(0::bigint, list_transform(range(1, len(f) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: case when t[n + 1] = f[k] then prior[k] + 1 else prior[k + 1] end)))) as new from grid where n < len(t))),
 back as (select l_orderkey, t, f, tab, len(t) as i, len(f) as j, []::bigint[] as m from grid where n = len(t)
  union all select l_orderkey, t, f, tab, case when t[i] = f[j] or tab[i][j + 1] >= tab[i + 1][j] then i - 1 else i end, case when t[i] = f[j] or tab[i][j + 1] < tab[i + 1][j] then j - 1 else j end, case when t[i] = f[j] then list_prepend(i, m) else m end from back where i > 0 and j > 0),
 e as (select l_orderkey, len(t) as nt, len(f) as nf, m from back where i = 0 or j = 0),
 g as (select l_orderkey, place - k as island, count(*) as n from (select l_orderkey, unnest(m) as place, generate_subscripts(m, 1) as k from e) group by all),
 h as (select l_orderkey, sum(n) filter (where n >= 2) as n from g group by l_orderkey)"""


@query(f"{_ALIGNED_SQL} select l_orderkey, strict, round_even((len(m) / nt)::double, 6) as loose, round_even((coalesce(h.n, 0) / nt)::double, 6) as hybrid, len(m)::bigint as moves_matched, nt::bigint as moves_expected, nf::bigint as moves_predicted from e left join h using (l_orderkey) join ({SQL['moves_strict']}) using (l_orderkey)")
def moves_loose_hybrid(spark, d):
    rows = moves.move_scores(_orders(spark, d), "compact", "said", prefix="")
    return rows.drop("compact", "said", "tab")


# Sampling.

_EDGES = [0, 500, 1000, 2000, 5000, 10000]
_DIM = ", ".join(f"({o}, '{n}', {lo}, {hi})" for o, n, lo, hi in sampling.buckets(_EDGES))
_BUCKET_SQL = f"b(ord, bucket, low, high) as (values {_DIM})"


@query(f"with {_BUCKET_SQL} select doc_id, bucket from documents left join b on n_chars >= low and n_chars < high")
def bucket_assign(spark, d):
    return _t(spark, d, "documents").select("doc_id", sampling.bucket_of(F.col("n_chars"), _EDGES).alias("bucket"))


@query(f"with {_BUCKET_SQL} select ord, bucket, count(doc_id) as n from b left join documents on n_chars >= low and n_chars < high group by all")
def bucket_counts(spark, d):
    return sampling.bucket_counts(_t(spark, d, "documents"), "n_chars", _EDGES)


@query("select n_nationkey, (50 // 7 + (n_nationkey % 7 < 50 % 7)::int)::int as quota from nation")
def allocate_quota(spark, d):
    parts = F.array(*[F.lit(x) for x in sampling.allocate(50, 7)])
    return _t(spark, d, "nation").select("n_nationkey", F.get(parts, F.col("n_nationkey") % 7).alias("quota"))


# The seed's first numbers of 32 bits; how they are drawn from, shuffled and sampled by is in the SQL.
_RAW = f"raw as (select {[(lambda g: [g.getrandbits(32) for _ in range(6000)])(random.Random(42))][0]}::bigint[] as x)"
_DREW = "(raw.x[pos] >> (32 - length(bin({m}))))"
_SAMPLE_SQL = f"""with recursive {_RAW}, {_BUCKET_SQL}, d as (select doc_id, ord, bucket, (row_number() over (partition by ord order by doc_id::varchar))::int as rank from documents join b on n_chars >= low and n_chars < high),
 z as (select b.ord, count(d.doc_id) as n, least(8, count(d.doc_id)) as take, count(d.doc_id) <= case when least(8, count(d.doc_id)) > 5 then 21 + 4 ** ceil(log(3 * least(8, count(d.doc_id))) / log(4)) else 21 end as pooled from b left join d on d.ord = b.ord group by b.ord),
 s as (select 0 as ord, 0 as i, 1 as pos, range(0, n) as pool, []::bigint[] as got from z where ord = 0
  union all select case when i >= take then s.ord + 1 else s.ord end, case when i >= take then 0 when ok then i + 1 else i end, case when i >= take then pos else pos + 1 end,
   case when i >= take then range(0, coalesce(after_n, 0)) when ok and pooled then list_transform(range(0, n), lambda q: case when q = r then pool[n - i] else pool[q + 1] end) else pool end, case when i >= take then []::bigint[] when ok then list_append(got, case when pooled then pool[r + 1] else r end) else got end
  from (select s.*, z.n, z.take, z.pooled, y.n as after_n, {_DREW.format(m="(case when z.pooled then greatest(z.n - i, 1) else z.n end)")} as r, r < case when z.pooled then z.n - i else z.n end and (z.pooled or not list_contains(got, r)) as ok from raw, s join z on z.ord = s.ord left join z y on y.ord = s.ord + 1) s),
 p as (select s.ord, unnest(got) + 1 as rank from s join z on z.ord = s.ord and s.i = z.take)"""


@query(f"{_SAMPLE_SQL} select doc_id, bucket, rank from d where exists (select 1 from p where p.ord = d.ord and p.rank = d.rank)")
def bucket_sample(spark, d):
    return sampling.sample_buckets(_t(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", _EDGES, total=40).select("doc_id", "bucket", "rank")


@query(f"with {_BUCKET_SQL}, r as (select doc_id, bucket, row_number() over (partition by bucket order by doc_id)::int as rank from documents join b on n_chars >= low and n_chars < high) select * from r where rank <= 5")
def bucket_first_k(spark, d):
    return sampling.first_k(_t(spark, d, "documents"), sampling.bucket_of(F.col("n_chars"), _EDGES), ["doc_id"], 5).select("doc_id", "bucket", "rank")


@query("with r as (select source, doc_id, (row_number() over (partition by source order by doc_id) - 1)::int as depth from documents) select * from r order by depth, source limit 50")
def round_robin_topk(spark, d):
    return sampling.round_robin(_t(spark, d, "documents"), "source", ["doc_id"], 50).select("source", "doc_id", "depth")


# Places are swapped from the last to the second, each with one that is drawn at or below it.
_SWAPPED = "list_transform(range(0, len({l})), lambda q: case when q = i then {l}[r + 1] when q = r then {l}[i + 1] else {l}[q + 1] end)"
_SHUFFLE_SQL = f"""with recursive {_RAW}, s as (select count(*) - 1 as i, 1 as pos, range(0, count(*)) as l from documents
  union all select case when r <= i then i - 1 else i end, pos + 1, case when r <= i then {_SWAPPED.format(l="l")} else l end from (select s.*, {_DREW.format(m="(i + 1)")} as r from s, raw where i > 0)),
 t as (select unnest(l[1:10]) as place from s where i <= 0), n as (select doc_id, row_number() over (order by doc_id) - 1 as place from documents)"""


@query(f"{_SHUFFLE_SQL} select doc_id from n join t using (place)")
def shuffled_limit(spark, d):
    return sampling.shuffled_limit(_t(spark, d, "documents").select("doc_id"), "doc_id", 10)


_STRATA_SQL = f"""with recursive {_RAW}, g as (select source, count(*) as n, row_number() over (order by min(doc_id)) as k from documents group by source),
 s as (select 1::bigint as k, n - 1 as i, 1 as pos, range(0, n) as l from g where k = 1
  union all select case when i <= 0 then s.k + 1 else s.k end, case when i <= 0 then after_n - 1 when r <= i then i - 1 else i end, case when i <= 0 then pos else pos + 1 end, case when i <= 0 then range(0, after_n) when r <= i then {_SWAPPED.format(l="l")} else l end
  from (select s.*, g.n as after_n, {_DREW.format(m="(i + 1)")} as r from raw, s left join g on g.k = s.k + 1 where i > 0 or g.n is not null) s),
 t as (select source, unnest(l) as place, generate_subscripts(l, 1) as depth from s join g on g.k = s.k where i <= 0), n as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as place from documents)"""


@query(f"{_STRATA_SQL} select source, doc_id from n join t using (source, place) order by depth, source limit 60")
def stratified_sample(spark, d):
    return sampling.stratified(_t(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 60)


@query("select min(doc_id) as doc_id from documents where trim(text) <> '' group by trim(text)")
def first_wins_dedupe(spark, d):
    return sampling.first_wins(_t(spark, d, "documents"), F.col("text"), ["doc_id"]).select("doc_id")


@query("select md5(text) as text_md5, count(*) as n from documents group by text having count(*) > 1")
def duplicate_keys(spark, d):
    return sampling.duplicates(_t(spark, d, "documents").select(F.md5("text").alias("text_md5")), "text_md5")


# Joins.


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)")
def resume_anti(spark, d):
    done = _t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return plans.to_build(_t(spark, d, "orders"), done, ["o_orderkey"]).select("o_orderkey")


@query("select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)")
def existing_semi(spark, d):
    done = _t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return plans.built(_t(spark, d, "orders"), done, ["o_orderkey"]).select("o_orderkey")


@query("with c as (select p_partkey as k, p_size + (p_partkey % 3 = 0)::int as size, p_retailprice + case when p_partkey % 5 = 0 then 1 else 0 end as mtime, p_partkey / 10 as duration from part where p_partkey % 4 <> 0) select p_partkey, c.duration from part left join c on p_partkey = k and p_size = size and abs(p_retailprice - mtime) <= 1e-6")
def cache_lookup(spark, d):
    part = _t(spark, d, "part")
    cache = part.where("p_partkey % 4 <> 0").selectExpr("p_partkey as path", "p_size + cast(p_partkey % 3 = 0 as int) as size", "p_retailprice + case when p_partkey % 5 = 0 then 1 else 0 end as mtime", "p_partkey / 10 as duration")
    return plans.cached(part.selectExpr("p_partkey as path", "p_size as size", "p_retailprice as mtime"), cache).select(F.col("path").alias("p_partkey"), "duration")


@query("select o_orderkey, case when o_orderkey % 2 = 0 then c_name else o_orderpriority end as truth from orders left join customer on c_custkey = o_custkey")
def truth_lookup(spark, d):
    files = _t(spark, d, "customer").select(F.concat(F.lit("gt/"), "c_custkey").alias("path"), F.col("c_name").alias("content"))
    rows = _t(spark, d, "orders").selectExpr("o_orderkey", "case when o_orderkey % 2 = 0 then concat('gt/', o_custkey) else '' end as ground_truth_path", "o_orderpriority as ground_truth")
    return plans.ground_truth(rows, files).select("o_orderkey", "truth")


@query("select doc_id, case when length(text) <= 2000 then text else rtrim(text[1:2000], ' ') || chr(10) || '…[truncated, see ground_truth_path]' end as preview from documents")
def truth_inline_preview(spark, d):
    return _t(spark, d, "documents").select("doc_id", items.inline_truth(F.col("text")).alias("preview"))


@query("select n_nationkey as k, n_name as name, n_regionkey::double as extra, '' as model_output, 'x' as cfg_v from nation union all select r_regionkey, r_name, null, '', 'x' from region")
def canonical_columns(spark, d):
    from ..sources import manifest

    a = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("double").alias("extra"))
    b = _t(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    rows = manifest.union([a, b]).withColumn("media_path", F.lit("m/x"))
    return manifest.canonical(rows, {"v": "x"}).select("k", "name", "extra", "model_output", "cfg_v")


# Questions and clips.

_SPEEDS = [("slow", 0.5), ("normal", 2.0), ("fast", 5.0)]


@query("with q as (select item_id::varchar as question_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::int as word_count from benchmark), c(mode, speed, speed_wps, fpw) as (select m, s, w, greatest(1, round_even(30.0 / w, 0)::int) from (values ('vanishing'), ('cumulative')) a(m), (values ('slow', 0.5::double), ('normal', 2.0::double), ('fast', 5.0::double)) b(s, w)) select question_id, word_count, mode, speed, speed_wps, fpw as frames_per_word, (word_count * (fpw + case when mode = 'vanishing' then 6 else 0 end))::bigint as n_frames, (word_count * (fpw + case when mode = 'vanishing' then 6 else 0 end)) / 30.0::double as duration_sec from q, c")
def condition_cross(spark, d):
    q = _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), F.size(items._split(F.col("text"))).alias("word_count"))
    return plans.conditions(q, _SPEEDS, ["vanishing", "cumulative"])


_WORDS_SQL = "w as (select item_id::varchar as question_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as ws from benchmark)"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), "text")


@query(f"with {_WORDS_SQL} select question_id, (2 * (i - 1) + g)::int as seg, case when g = 0 then ws[i] else '' end as shown, case when g = 0 then 15 else 6 end as hold from w, unnest(range(1, len(ws) + 1)) as x(i), range(2) as y(g)")
def word_reveal_vanishing(spark, d):
    return plans.reveal(_questions(spark, d), items._split(F.col("text")), cumulative=False, hold=15, gap=6)


@query(f"with {_WORDS_SQL} select question_id, (i - 1)::int as seg, array_to_string(ws[1:i], ' ') as shown, 15 as hold from w, unnest(range(1, len(ws) + 1)) as x(i)")
def word_reveal_cumulative(spark, d):
    return plans.reveal(_questions(spark, d), items._split(F.col("text")), cumulative=True, hold=15)


_REVEALED_SQL = f"""{_WORDS_SQL}, a as (select 'cumulative' as mode, array_to_string(ws[1:i], ' ') as shown, 15 as hold from w, unnest(range(1, len(ws) + 1)) as x(i)
 union all select 'vanishing', case when g = 0 then ws[i] else '' end, case when g = 0 then 15 else 6 end from w, unnest(range(1, len(ws) + 1)) as x(i), range(2) as y(g))"""


def _revealed(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d)
    parts = [plans.reveal(q, items._split(F.col("text")), cumulative=c, hold=15, gap=6).withColumn("mode", F.lit("cumulative" if c else "vanishing")) for c in (True, False)]
    return parts[0].unionByName(parts[1])


@query(f"with {_REVEALED_SQL}, f as (select shown, list_sort(list_distinct(list(mode))) as modes, count(*) as n_segments, sum(hold)::bigint as n_held from a group by shown) select sha256(strlen(shown)::varchar || ':' || shown) as frame, array_to_string(modes, ',') as modes, n_segments, n_held from f")
def frames_once(spark, d):
    """What the clips of all questions show, each frame once, whichever clips refer to it."""
    rows = _revealed(spark, d)
    modes = plans.referred(rows, ["shown"]).groupBy("frame").agg(F.array_join(F.sort_array(F.collect_set("mode")), ",").alias("modes"))
    return plans.distinct_frames(rows, ["shown"]).join(modes, "frame").select("frame", "modes", "n_segments", "n_held")


@query(f"with {_REVEALED_SQL} select mode, count(*) as referred, count(distinct shown) as distinct_frames, sum(hold)::bigint as held from a group by mode")
def frames_by_condition(spark, d):
    """How many frames the clips of a condition refer to, how many of them differ, and for how many they are held."""
    return plans.referred(_revealed(spark, d), ["shown"]).groupBy("mode").agg(F.count("*").alias("referred"), F.countDistinct("frame").alias("distinct_frames"), F.sum("hold").cast("bigint").alias("held"))


@query("with s as (select l_orderkey, l_quantity::bigint * 6 as h from lineitem), g as (select l_orderkey, sum(h)::bigint as n_frames, list_reduce(list(h), lambda a, b: gcd(a, b))::bigint as g from s group by 1) select l_orderkey, n_frames, case when g = 0 then 1 else g end as divisor, n_frames // (case when g = 0 then 1 else g end) as piped, round_even(1 - (n_frames // (case when g = 0 then 1 else g end)) / n_frames, 6) as savings from g")
def timeline_gcd(spark, d):
    return plans.reduced(_t(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity").cast("bigint") * 6).alias("hold")), "l_orderkey")


@query("with b as (select r_regionkey, (3 + 7.5 * r_regionkey)::double as seconds, greatest(1, round_even((3 + 7.5 * r_regionkey)::double * 30, 0)::int) as budget from region), i as (select *, least(60, floor(budget * 0.2::double)::int) as intro_frames, least(120, floor(budget * 0.2::double)::int) as outro_frames from b), m as (select *, greatest(1, (budget - intro_frames - outro_frames) // 36) as n_moves from i) select *, intro_frames + n_moves * 36 + outro_frames as total_frames, (intro_frames + n_moves * 36 + outro_frames) / 30.0::double as actual_seconds from m")
def clip_plan(spark, d):
    s = _t(spark, d, "region").select("r_regionkey", (3 + 7.5 * F.col("r_regionkey")).alias("seconds"))
    return s.withColumns(items.clip_plan(F.col("seconds"), fps=30, per_move=36, intro=60, outro=120))


@query("with r as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber)::int as seg from lineitem), k as (select *, max(seg) over (partition by l_orderkey) as m from r where seg <= 4) select l_orderkey, seg, case when seg = m then 36 + 120 else 36 end as hold from k union all select distinct l_orderkey, 0, 60 from k")
def clip_timeline(spark, d):
    return plans.clip_timeline(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", n_moves=4, per_move=36, intro=60, outro=120)


@query("select l_orderkey, l_linenumber, coalesce(lag(l_returnflag) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag), '-') as before from lineitem")
def state_before(spark, d):
    return plans.before(_t(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], "l_returnflag", "-").select("l_orderkey", "l_linenumber", "before")


@query("with x as (select page_id, url, trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._-') as s from pages) select page_id, case when s = '' then 'clip' else s end as safe, regexp_extract(url, '[^/]*$') as file, regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', ''), '_(test|val|dev)$', '') as subject from x")
def names_of_pages(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", items.safe_id(u).alias("safe"), items.file_name(u).alias("file"), items.subject_of(u).alias("subject"))


_SUBJECT = "case n_nationkey % 6 when 0 then 'high_school_physics' when 1 then 'clinical_knowledge' when 2 then 'world_religions' when 3 then 'college_medicine_math' when 4 then 'formal_logic' else 'sociology' end"


@query(f"select n_nationkey, case when regexp_matches({_SUBJECT}, 'medicine|medical|anatomy|clinical|virology|nutrition') then 'medical' when regexp_matches({_SUBJECT}, 'math|physics|chemistry|biology|computer|engineering|statistics|astronomy|econometrics|electrical') then 'stem' when regexp_matches({_SUBJECT}, 'history|philosophy|law|religions|moral|logic|prehistory') then 'humanities' else 'commonsense' end as domain from nation")
def infer_domain(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", items.infer_domain(F.expr(_SUBJECT)).alias("domain"))


@query("select p_partkey::varchar as id, 'Which ' || p_name as stem, p_brand as a, p_type as b, 'x' || p_size as c, 'none' as d, chr((65 + p_partkey % 4)::int) as answer from part")
def question_normalise(spark, d):
    from ..sources import questions

    rows = _t(spark, d, "part").selectExpr("p_partkey as _row", "cast(p_partkey as string) as qid", "concat('Which ', p_name) as question", "array(p_brand, p_type, concat('x', p_size), 'none') as choices", "cast(p_partkey % 4 as int) as answer")
    o = F.col("options")
    return questions.shaped(rows).select("id", "stem", *[o[k].alias(k.lower()) for k in items.LETTERS], "answer")


@query("""select o_orderkey, substr(sha256('{"caf\\u00e9":{"a":[' || o_custkey || ',null],"price":' || o_totalprice::double || '},"name":"' || o_orderpriority || '\\u2026\\"","run":{"seed":' || o_custkey % 7 || '}}'), 1, 12) as hash from orders""")
def config_hash_rows(spark, d):
    """Of configurations in a column: nested, with numbers, escapes and settings that don't count."""
    run = F.struct(F.lit(8).alias("workers"), (F.col("o_custkey") % 7).alias("seed"), F.lit("x").alias("run_id"))
    price = F.struct(F.col("o_totalprice").cast("double").alias("price"), F.array("o_custkey", F.lit(None).cast("bigint")).alias("a"))
    whole = F.struct(run.alias("run"), F.concat("o_orderpriority", F.lit('…"')).alias("name"), price.alias("café"))
    return _t(spark, d, "orders").select("o_orderkey", config.config_hashes(whole, "struct").alias("hash"))


_RATE = "case n_nationkey % 7 when 0 then '30/1' when 1 then '30000/1001' when 2 then 'N/A' when 3 then '0/0' when 4 then '29.97' when 5 then '' else ' 25 ' end"


@query(f"with x as (select n_nationkey, {_RATE} as r from nation) select n_nationkey, case when contains(r, '/') then try_cast(split_part(r, '/', 1) as double) / nullif(try_cast(split_part(r, '/', 2) as double), 0) else try_cast(trim(r) as double) end as fps from x")
def rate_parse(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", items.rate(F.expr(_RATE)).alias("fps"))


# Reports and prompts.


@query("select page_id, replace(replace(replace(replace(replace(html, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026'), chr(8232), '\\u2028'), chr(8233), '\\u2029') as safe from pages")
def json_script_escape(spark, d):
    return _t(spark, d, "pages").select("page_id", items.script_safe(F.col("html")).alias("safe"))


@query("select n_nationkey::varchar as sample_id, '{' || concat_ws(',', '\"n_regionkey\":\"' || n_regionkey || '\"', case when n_nationkey % 3 = 0 then null else '\"note\":\"' || n_name || '\"' end) || '}' as details from nation")
def report_details(spark, d):
    rows = _t(spark, d, "nation").selectExpr("cast(n_nationkey as string) as sample_id", "n_regionkey", "case when n_nationkey % 3 = 0 then ' ' else n_name end as note", "1.0 as score_x", "2 as cfg_y")
    return report.details(rows)


@query("select doc_id::varchar as sample_id, lang as condition, case when doc_id % 5 = 0 then null else n_chars::double end as score_x from documents where contains(lower(concat_ws(' ', doc_id::varchar, source, text)), 'src1') and lang = 'en'")
def report_search_sort(spark, d):
    rows = _t(spark, d, "documents").selectExpr("cast(doc_id as string) as sample_id", "lang as condition", "source as ground_truth", "text as model_output", "case when doc_id % 5 = 0 then null else double(n_chars) end as score_x")
    return report.search(rows, "SRC1", "en", "score_x").select("sample_id", "condition", "score_x")


_COND = "case n_nationkey % 5 when 0 then 'text' when 1 then 'static_image' when 2 then 'vanishing_slow' when 3 then 'cumulative_fast' else 'video_5s' end"


@query(f"select n_nationkey, case when n_nationkey % 2 = 1 then 'task' when {_COND} = 'text' then 'user_text' when {_COND} = 'static_image' then 'user_static_image' when starts_with({_COND}, 'vanishing') or starts_with({_COND}, 'cumulative') then 'user_video' end as kind from nation")
def prompt_for_condition(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", items.prompt_kind(F.expr("case when n_nationkey % 2 = 1 then 'asl' else 'wbw_mcq' end"), F.expr(_COND)).alias("kind"))


_PROMPT = "concat('Say {stem} and {', lower(r_name), '} or {{strict}}: {stem}')"


@query("select r_regionkey, array_to_string(list_sort(list_distinct(case when contains(r_name, ' ') then ['stem'] else ['stem', lower(r_name)] end)), ',') as fields from region")
def prompt_placeholders(spark, d):
    return _t(spark, d, "region").select("r_regionkey", F.array_join(items.placeholders(F.expr(_PROMPT)), ",").alias("fields"))


@query("select r_regionkey, 'Q: ' || r_name || ' {x}' as prompt from region")
def prompt_render(spark, d):
    return _t(spark, d, "region").select("r_regionkey", items.render(F.lit("Q: {stem} {{x}}"), {"stem": F.col("r_name")}).alias("prompt"))


# Chess: as many games as the reference plays, to its limit.

_GAMES, _HALF_MOVES = 20, 600


@query()
def random_games(spark, d):
    return chess.games(spark, _GAMES, seed=7, limit=_HALF_MOVES)


@query()
def game_transcripts(spark, d):
    return chess.transcripts(chess.games(spark, _GAMES, seed=7, limit=_HALF_MOVES))


@query("select * from (values (1, 20), (2, 400), (3, 8902), (4, 197281)) x(depth, nodes)")
def perft(spark, d):
    return chess.perft_counts(spark, 4)


_TOLD = "case when c_custkey % 3 = 0 then 'said \"so\",' || chr(10) || c_name else '  ' || c_name end"


@query(f"select c_custkey::varchar as sample_id, 'asl' as experiment, c_mktsegment as condition, {_TOLD} as model_output, c_nationkey::varchar as game_index from customer")
def manifest_roundtrip(spark, d):
    """Rows written as one CSV file into the shared folder, which the driver sees as a path, and read again; quoted cells hold line ends."""
    from .. import storage
    from ..sources import manifest

    rows = _t(spark, d, "customer").selectExpr("cast(c_custkey as string) as sample_id", "'asl' as experiment", "c_mktsegment as condition", f"{_TOLD} as model_output", "c_nationkey as game_index")
    path = storage.scratch_path(spark, "manifest").removeprefix("file://") + ".csv"
    manifest.write_file(rows, path)
    return manifest.read(spark, f"file://{path}")


from . import catalogue_runs  # noqa: E402, F401  registers its queries here
