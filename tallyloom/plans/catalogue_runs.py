"""Queries of runs, question sets and reports over the driver's tables, and the same in SQL; part of the catalogue."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import items
from ..operators import chess, evaluate, sampling
from ..sources import questions
from . import config, experiments, report
from .catalogue import _t, query

_NOW = dt.datetime(2024, 5, 6, 7, 8, 9)


def _settings(name: str, params: dict) -> config.Settings:
    return config.Settings.of({"experiment": name, "run": {"output_root": "/runs", "run_id": "r1", "seed": 7}, "params": params})


def _questions(spark, d: str) -> DataFrame:
    options = "map('A', p_brand, 'B', p_type, 'C', concat('size ', p_size), 'D', 'none of these')"
    return _t(spark, d, "part").selectExpr("p_partkey as _row", "concat('p', p_partkey) as id", "concat('Which  ', p_name, ' is it?') as stem", f"{options} as options", "substring('ABCD', cast(p_partkey % 4 as int) + 1, 1) as answer", "'' as domain", "cast(null as string) as difficulty", "p_brand as source")


# The words of a question are those of its stem and options, and a letter before each option.
_ASKED = """a as (select p_partkey, 'p' || p_partkey as id, 'Which  ' || p_name || ' is it?' as stem, p_brand as oa, p_type as ob, 'size ' || p_size as oc, 'none of these' as od, substr('ABCD', (p_partkey % 4)::int + 1, 1) as answer, p_brand as source from part),
 q as (select *, len(list_filter(regexp_split_to_array(stem || ' (A) ' || oa || ' (B) ' || ob || ' (C) ' || oc || ' (D) ' || od, '\\s+'), lambda w: w <> '')) as words from a)"""


@query(f"""with {_ASKED}, m(mode, speed, wps) as (values ('static', null, null::double), ('vanishing', 'fast', 5.0), ('vanishing', 'slow', 0.5), ('cumulative', 'fast', 5.0), ('cumulative', 'slow', 0.5)),
 r as (select *, case when mode = 'static' then id || '_static' else id || '_' || mode || '_' || speed end as sample_id from q, m)
 select sample_id, case when mode = 'static' then 'static_image' else mode || '_' || speed end as condition, case when mode = 'static' then 'image' else 'video' end as media_type, 'media/' || sample_id || case when mode = 'static' then '.jpg' else '.mp4' end as media_path,
 answer as ground_truth, id as question_id, words::int as word_count, stem, oa as option_a, ob as option_b, oc as option_c, od as option_d, source as question_source, mode, speed, wps as speed_wps, case when wps is not null then greatest(2, round_even(30 / wps, 0)) end::int as frames_per_word from r""")
def word_rows(spark, d):
    """Every question in every condition, as the word-by-word run plans it."""
    params = {"questions_path": "unused", "speeds": {"slow": 0.5, "fast": 5.0}, "min_frames_per_word": 2}
    rows = experiments.build(_settings("wbw_mcq", params), _NOW).planned(_questions(spark, d))
    return rows.drop("target", "domain", "difficulty", "_words", "_text").withColumn("frames_per_word", F.when(F.col("mode") != "static", F.col("frames_per_word")))


_CLIPS = "c as (select doc_id, 'clip ' || doc_id as name, n_chars / 100.0 as duration, case when doc_id % 3 = 0 then null else n_chars / 400.0 end as s, n_chars / 150.0 as e, coalesce(source, '') as sentence from documents)"


@query(f"""with {_CLIPS}, b as (select *, case when duration >= 0 and duration < 10 then 'short' when duration >= 10 and duration < 60 then 'long' end as bucket, case when e > s then e - s end as part from c)
 select 'clip_' || doc_id as sample_id, 'video' || coalesce('_' || bucket, '') as condition, 'media/clip_' || doc_id || '.mp4' as media_path, trim(sentence) as ground_truth, coalesce(bucket, '') as bucket, name as source_name,
 round_even(duration, 3) as source_duration_sec, round_even(s, 6) as start_sec, round_even(case when part is null then 8.0 else least(part, 8.0) end, 6) as clip_sec from b""")
def clip_rows(spark, d):
    """Every clip with its bucket and the part of the video that it takes, as the sign-language run plans it."""
    params = {"metadata_csv": "unused", "video_dir": "unused", "buckets": {"edges": [0, 10, 60], "labels": ["short", "long"]}, "total_samples": 9, "use_time_range": True, "max_clip_seconds": 8}
    rows = _t(spark, d, "documents").selectExpr(
        "concat('clip ', doc_id) as name", "'v' as path", "n_chars / 100.0D as duration", "case when doc_id % 3 <> 0 then n_chars / 400.0D end as start", "n_chars / 150.0D as end", "trim(coalesce(source, '')) as sentence", "'' as video_id", "'' as sentence_id"
    )
    out = experiments.build(_settings("asl", params), _NOW).planned(rows)
    return out.select("sample_id", "condition", "media_path", "ground_truth", "bucket", "source_name", "source_duration_sec", F.bround("_start", 6).alias("start_sec"), F.bround("_seconds", 6).alias("clip_sec"))


_TIMES = "t(label, s) as (values ('a', 1.0), ('b', 5.0), ('c', 30.0), ('d', 600.0)), p as (select *, greatest(1, round_even(s * 30, 0))::int as budget from t), f as (select *, least(60, floor(budget * 0.1))::int as i, least(120, floor(budget * 0.2))::int as o from p), n as (select *, greatest(1, (budget - i - o) // 36)::int as n from f)"
_CHESS = {"num_games": 5, "durations": [{"label": k, "seconds": s} for k, s in (("a", 1), ("b", 5), ("c", 30), ("d", 600))]}


@query(f"with {_TIMES} select label, s as target_seconds, i as intro_frames, o as outro_frames, n as n_moves, i + 36 * n + o as total_frames, round_even((i + 36 * n + o) / 30, 6) as actual_seconds from n")
def clip_budgets(spark, d):
    """The plan of every configured duration."""
    rows = experiments.build(_settings("chess", _CHESS), _NOW).clips(spark)
    return rows.select("label", "target_seconds", "intro_frames", "outro_frames", "n_moves", "total_frames", F.bround("actual_seconds", 6).alias("actual_seconds"))


@query(f"with {_TIMES}, x as (select *, (i + 36 * n + o) / 30 as actual from n) select max(n) as required_moves, list_sort(list(label) filter (where abs(actual - s) / s > 0.1))::varchar as off_target from x")
def clip_notes(spark, d):
    """The moves that the longest clip needs, and the clips that last a tenth more or less than they should."""
    made = experiments.build(_settings("chess", _CHESS), _NOW)
    clips = made.clips(spark)
    labels = "[" + ", ".join(n.split("'")[1] for n in made.notes(clips)) + "]"
    return clips.agg(F.max("n_moves").alias("required_moves")).withColumn("off_target", F.lit(labels))


@query("select n_nationkey::varchar as sample_id, case when n_regionkey = 0 then 7 else n_regionkey end::bigint as seed, 'chess' as experiment, 'r1' as run_id, '2024-05-06T07:08:09' as generated_at from nation")
def provenance(spark, d):
    """Rows with the run they come from; a row without a seed has the run's."""
    rows = _t(spark, d, "nation").selectExpr("cast(n_nationkey as string) as sample_id", "nullif(n_regionkey, 0) as seed")
    return experiments.stamped(rows, _settings("chess", _CHESS), "r1", _NOW).select("sample_id", "seed", "experiment", "run_id", "generated_at")


@query("select count(*) filter (where event_id % 5 = 0)::int as skipped, sum(case when event_id % 5 <> 0 and event_id % 7 <> 0 then user_id end)::bigint as frames_encoded, sum(case when event_id % 5 <> 0 and event_id % 7 <> 0 then user_id // 2 end)::bigint as frames_piped from events")
def run_totals(spark, d):
    """A run's sums over its artifacts."""
    rows = _t(spark, d, "events").selectExpr("event_id % 5 = 0 as skipped", "case when event_id % 7 = 0 then 'failed' end as error", "user_id as n_frames", "user_id div 2 as piped_frames")
    got = experiments.totals(rows)
    return spark.createDataFrame([(got["skipped"], got["frames_encoded"], got["frames_piped"])], "skipped int, frames_encoded bigint, frames_piped bigint")


@query("select list_sort(list(distinct event_type))::varchar as experiments, count(distinct user_id % 3) as conditions from events")
def report_counts(spark, d):
    rows = _t(spark, d, "events").selectExpr("event_type as experiment", "cast(user_id % 3 as string) as condition")
    return evaluate.experiments_of(rows).select(F.concat(F.lit("["), F.array_join("experiments", ", "), F.lit("]")).alias("experiments"), "conditions")


_MEDIA = "case page_id % 5 when 0 then 'media/a' || page_id || '.MP4' when 1 then 'media/b.jpeg' when 2 then 'x.txt' when 3 then '' end"


@query(f"""with p as (select page_id, {_MEDIA} as path from pages) select page_id, case when lower(path) like '%.mp4' then 'video' when path like '%.jpeg' then 'image' else '' end as kind, case when coalesce(path, '') = '' then '' else '../run/' || path end as link from p""")
def report_media(spark, d):
    """What a report shows of a media path, and how it links to it."""
    rows = _t(spark, d, "pages").selectExpr("page_id", f"{_MEDIA} as path")
    return rows.select("page_id", F.coalesce(report.media_kind(F.col("path")), F.lit("")).alias("kind"), report.media_link(F.col("path"), "/out/run", "/out/page").alias("link"))


@query("select 'score_a' as metric, count(*) > 0 and count(*) = count(try_cast(props as double)) as numeric from events union all select 'score_b', true union all select 'score_c', false")
def numeric_metrics(spark, d):
    """Which score columns hold numbers alone: JSON text doesn't, numbers as text do, truth values don't."""
    rows = _t(spark, d, "events").selectExpr("props as score_a", "case when event_id % 2 = 0 then cast(value as string) else '' end as score_b", "event_id % 2 = 0 as score_c")
    found = evaluate.metrics_of(rows, all_numbers=True)
    return spark.createDataFrame([(c, c in found) for c in rows.columns], "metric string, numeric boolean")


_RAW = """select p_partkey as _row, case when p_partkey % 11 = 0 then ' ' else ' about ' || p_name end as question, case when p_partkey % 7 = 0 then {three} else {four} end as choices, case p_partkey % 6 when 0 then ' b ' when 1 then '3' when 2 then '4' when 3 then 'E' when 4 then 'A' else '0' end as answer, case when p_partkey % 5 = 0 then '' else p_type end as subject from part"""
_RAW_SQL = _RAW.format(three="[p_brand, p_type, 'c']", four="[p_brand, ' ' || p_type || ' ', 'size ' || p_size, 'd']")
_USABLE = f"""w as ({_RAW_SQL}), u as (select _row, trim(question) as stem, choices, case upper(trim(answer)) when 'B' then 'B' when 'A' then 'A' when '3' then 'D' when '0' then 'A' end as answer, case when subject = '' then 'MMLU' else subject end as source from w where trim(question) <> '' and len(choices) = 4),
 g as (select *, len(string_split(stem, ' ')) + list_sum(list_transform(choices, lambda c: len(string_split(trim(c), ' ')) + 1)) as words from u where answer is not null)"""


def _usable(spark, d: str) -> DataFrame:
    raw = _t(spark, d, "part").sparkSession.sql(_RAW.format(three="array(p_brand, p_type, 'c')", four="array(p_brand, ' ' || p_type || ' ', 'size ' || p_size, 'd')").replace("from part", "from {part}"), part=_t(spark, d, "part"))
    return questions.usable(raw)


@query(f"with {_USABLE} select _row, stem, trim(choices[2]) as b, answer, source, words::int as words from g")
def questions_usable(spark, d):
    """Raw rows that make a question, with their words."""
    return _usable(spark, d).select("_row", "stem", F.element_at("options", F.lit("B")).alias("b"), "answer", "source", questions.script_words().alias("words"))


@query(f"with {_USABLE} select 'q_' || lpad((row_number() over (order by _row) - 1)::varchar, 5, '0') as id, _row from g where words <= 12")
def questions_numbered(spark, d):
    """Questions of at most twelve words, numbered without gaps."""
    return questions.chosen(_usable(spark, d).orderBy("_row"), max_words=12).select("id", "_row")


@query(f"with {_USABLE} select count(*) as n, count(distinct source) as subjects, min(words)::int as least, list_sort(list(words))[count(*) // 2 + 1]::int as median, max(words)::int as most from g")
def questions_lengths(spark, d):
    return questions.lengths(_usable(spark, d))


@query(f"""with {_ASKED} select id, words::int as word_count, list_filter(regexp_split_to_array(stem, '\\s+'), lambda w: w <> '')[1] || '|' || od as head from q""")
def question_dict(spark, d):
    """A question as a record with its words."""
    rows = _questions(spark, d).select(questions.as_dict().alias("q"))
    return rows.select("q.id", "q.word_count", F.concat_ws("|", F.get("q.word_sequence", F.lit(0)), F.element_at("q.options", F.lit("D"))).alias("head"))


@query("""with m as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as ply from lineitem),
 x as (select l_orderkey, ply, ((ply + 1) // 2)::varchar as no, case when ply % 2 = 1 then 'White' else 'Black' end as color, chr((97 + ply % 8)::int) || '2' as src, chr((97 + ply % 8)::int) || '4' as dst from m)
 select l_orderkey, string_agg(no || ' ' || color || ' ' || src || ' ' || dst, '; ' order by ply) as compact, 'Game #' || l_orderkey || ' — Move Transcription' || chr(10) || repeat('=', 46) || chr(10) || chr(10) || 'Move    Turn      Source    Destination' || chr(10) || '----    ----      ------    -----------' || chr(10)
 || string_agg(rpad(no, 6, ' ') || '  ' || rpad(color, 8, ' ') || '  ' || rpad(src, 8, ' ') || '  ' || dst, chr(10) order by ply) || chr(10) || chr(10) || 'Result: done' || chr(10) || 'Total half-moves: ' || count(*) || chr(10) as transcript from x group by l_orderkey""")
def game_texts(spark, d):
    """The transcripts of whole orders, in columns of fixed width and in one line."""
    rows = _t(spark, d, "lineitem").selectExpr("l_orderkey", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as ply")
    plies = rows.selectExpr("cast(l_orderkey as string) as sample_id", "ply", "(ply + 1) div 2 as move_no", "case when ply % 2 = 1 then 'White' else 'Black' end as color", "char(97 + ply % 8) || '2' as src", "char(97 + ply % 8) || '4' as dst", "'' as board_after")
    clips = rows.groupBy("l_orderkey").agg(F.count("*").alias("n_half_moves")).selectExpr("cast(l_orderkey as string) as sample_id", "l_orderkey as game_index", "'done' as game_result", "n_half_moves")
    return chess.transcript_texts(plies, clips).select(F.col("sample_id").cast("bigint").alias("l_orderkey"), "compact", "transcript")


@query("select c_nationkey, c_custkey, (row_number() over (partition by c_nationkey order by c_name))::int as rank from customer")
def group_ranks(spark, d):
    """A row's place in its group, found over ranges."""
    return sampling.ranked(_t(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name"), ["c_nationkey"], ["c_name"]).select("c_nationkey", "c_custkey", "rank")


@query("select s_suppkey, s_name as identity from supplier")
def identities(spark, d):
    """What tells rows apart: the first of the usual names that is there."""
    rows = _t(spark, d, "supplier").selectExpr("s_suppkey", "s_name as SENTENCE_NAME", "'x' as name")
    return rows.select("s_suppkey", sampling.identity(rows).alias("identity"))


@query("select p_partkey, array_to_string(list_filter([p_brand, p_type, p_brand, 'x'], lambda x, i: list_position([p_brand, p_type, p_brand, 'x'], x) = i), ',') as modes from part")
def modes_once(spark, d):
    """A list without what came before."""
    return _t(spark, d, "part").select("p_partkey", F.array_join(F.array_distinct(F.array("p_brand", "p_type", "p_brand", F.lit("x"))), ",").alias("modes"))


@query("""with t as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as seg from lineitem), c as (select *, max(seg) over (partition by l_orderkey) as last from t where seg <= 4),
 s as (select l_orderkey, seg * 100 + k as place, 1 as hold from c, range(14) x(k) union all select l_orderkey, seg * 100 + 14, 22 + case when seg = last then 30 else 0 end from c union all select distinct l_orderkey, 0, 15 from c)
 select l_orderkey, place::int as place, hold::int as hold from s""")
def animated_segments(spark, d):
    """Clips of moves that slide: fourteen frames of one, then the position held, the last one for the outro too."""
    from ..operators import plans

    rows = _t(spark, d, "lineitem").selectExpr("l_orderkey", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as ply")
    return plans.clip_timeline(rows, "l_orderkey", "ply", n_moves=4, per_move=22, intro=15, outro=30, slides=14).select("l_orderkey", F.col("place").cast("int").alias("place"), F.col("hold").cast("int").alias("hold"))
