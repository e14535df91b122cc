"""Collocations: phrases whose words occur together far more often than apart, mined by pivots as in MG-FSM.

Words of a language are ranked by how often they occur. Each place in a text is the pivot of one fragment: the word there
and up to two neighbours on each side, cut where a word is rarer than the pivot, occurs too seldom to be in any phrase, or
a piece ends; on the left also where the pivot itself stands, as that place owns what they share. Fragments, counted for
each block of texts, go to their pivot, and are mined there: every phrase that holds the pivot is counted, and as a
phrase has one rarest word and one first place of it, it is counted nowhere else.

A pivot of rank k has at most a k-th of all words, and fragments of k words only, of which there are few where k is small; as
equal ones are counted before they are sent, no pivot gets more than a small share of the rows, however common a word is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import places, scratch, workers

#: Bytes of text in a block, of which words are told apart and fragments counted at once; longer texts are cut between pieces.
BLOCK = 8 << 20
#: Words of dictionaries that are sent to all tasks; longer dictionaries are joined.
SENT_WORDS = 500_000
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = "block bigint, lang string, n bigint, codes binary, n_codes bigint, words array<struct<word:string,n:bigint>>"


def _cut(data: bytes) -> Iterator[bytes]:
    """data in parts of about BLOCK bytes that end with a piece, whose lengths don't matter to the phrases."""
    at = 0
    while len(data) - at > BLOCK:
        end = max(data.rfind(c, at, at + BLOCK) for c in (b".", b",", b"\n", b"!", b"?", b";", b":"))
        if end < 0:
            found = _ENDS.search(data, at + BLOCK)
            end = found.start() if found else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def coded(data: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of lower-case text in UTF-8 as numbers in the order in which they come up, -1 between pieces; the words; their counts."""
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return np.empty(0, np.int32), pa.array([], pa.string()), np.empty(0, np.int64)
    kept = np.cumsum(inside)
    offsets = np.append(kept[starts] - 1, kept[-1]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    codes = words.indices.to_numpy()
    piece = np.cumsum(kind == 2)[starts]
    counts = np.bincount(codes, minlength=len(words.dictionary))
    return np.insert(codes, np.flatnonzero(np.diff(piece)) + 1, -1).astype(np.int32), words.dictionary.cast(pa.string()), counts


def _blocks(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Blocks of texts of a language, their words as numbers, with the words and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def made(name: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for part in _cut(b"\n".join(waiting.pop(name))):
                codes, words, counts = coded(part)
                if len(words):
                    rows = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.StructArray.from_arrays([words, pa.array(counts)], ["word", "n"]))
                    packed = pa.compress(codes.tobytes(), codec="zstd", asbytes=True)
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([name]), pa.array([int(counts.sum())]), pa.array([packed], pa.binary()), pa.array([len(codes)]), rows], names=["block", "lang", "n", "codes", "n_codes", "words"])
                    number += 1
            size[name] = 0

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    data = t.encode().translate(_LOWER)
                    waiting.setdefault(name, []).append(data)
                    size[name] = size.get(name, 0) + len(data) + 1
                    if size[name] >= BLOCK:
                        yield from made(name)
            # Texts of many languages wait for no more than a block each, and all together for no more than four.
            while sum(size.values()) > 4 * BLOCK:
                yield from made(max(size, key=size.get))
        for name in list(waiting):
            yield from made(name)

    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).mapInArrow(workers.task(run), _BLOCK)


def fragments(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the ranks at places of texts (-1 for none), the distinct fragments and their counts.

    A fragment is a row of pivot, second and first neighbour on the left, first and second on the right, -1 where it is cut;
    those of a pivot alone are left out.
    """
    around = np.concatenate(([-1, -1], ranks, [-1, -1]))
    l2, l1, x, r1, r2 = (around[i : i + len(ranks)] for i in range(5))
    l1 = np.where((l1 >= 0) & (l1 < x), l1, -1)
    l2 = np.where((l1 >= 0) & (l2 >= 0) & (l2 < x), l2, -1)
    r1 = np.where((r1 >= 0) & (r1 <= x), r1, -1)
    r2 = np.where((r1 >= 0) & (r2 >= 0) & (r2 <= x), r2, -1)
    some = (l1 >= 0) | (r1 >= 0)
    names = ["pivot", "l2", "l1", "r1", "r2"]
    found = pa.table([c[some] for c in (x, l2, l1, r1, r2)], names=names).group_by(names, use_threads=False).aggregate([([], "count_all")])
    return np.stack([found[c].to_numpy() for c in names]), found["count_all"].to_numpy()


_FRAGMENT = "lang string, pivot bigint, l2 bigint, l1 bigint, r1 bigint, r2 bigint, n bigint"


def _fragments(blocks: DataFrame) -> DataFrame:
    """The fragments of blocks, which have the numbers of their words that are ranked, and those ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, codes, n, known in zip(*(batch.column(i) for i in range(4))):
                flat = known.values
                code, rank = flat.field("code").to_numpy(), flat.field("rank").to_numpy()
                codes = np.frombuffer(pa.decompress(codes.as_py(), decompressed_size=n.as_py() * 4, codec="zstd"), np.int32)
                order = np.sort(rank)
                table = np.full(max(int(code.max()), int(codes.max())) + 2, -1, np.int32)  # the last one stands for -1
                table[code] = np.searchsorted(order, rank)
                rows, counts = fragments(table[codes])
                back = np.append(order, -1)
                for at in range(0, len(counts), 100_000):
                    some = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(counts[some])), *[pa.array(back[r[some]]) for r in rows], pa.array(counts[some])], names=["lang", "pivot", "l2", "l1", "r1", "r2", "n"])

    return blocks.select("lang", "codes", "n_codes", "known").mapInArrow(workers.task(run), _FRAGMENT)


def _mined(parts: DataFrame, least: int) -> DataFrame:
    """lang, pivot, w1, w2, w3 (-1 in phrases of two words) and a, of phrases that occur least times or more.

    Fragments are dealt out once, by pivot; counting a pivot's phrases needs no other shuffle.
    """
    phrase = lambda a, b, c, all_: F.when(all_, F.struct(F.col(a).alias("w1"), F.col(b).alias("w2"), (F.col(c) if c else F.lit(-1).cast("bigint")).alias("w3")))
    left, right = F.col("l1") >= 0, F.col("r1") >= 0
    held = F.array(phrase("l1", "pivot", None, left), phrase("pivot", "r1", None, right), phrase("l2", "l1", "pivot", F.col("l2") >= 0), phrase("l1", "pivot", "r1", left & right), phrase("pivot", "r1", "r2", F.col("r2") >= 0))
    rows = parts.repartition("lang", "pivot").select("lang", "pivot", "n", F.explode(held).alias("p")).where("p is not null")
    return rows.groupBy("lang", "pivot", "p.w1", "p.w2", "p.w3").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def counted(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of two and three words that occur least times or more, the words that do, with their ranks, and each language's number of words."""
    blocks = scratch.stored(_blocks(docs, text, lang), "blocks")
    sizes = scratch.stored(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "sizes", 8)
    words = blocks.select("block", "lang", F.posexplode("words").alias("code", "w")).select("block", "lang", "code", "w.word", "w.n")
    often = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    often = scratch.stored(often.withColumn("down", -F.col("f")), "words")
    often = scratch.stored(places.placed(often, ["lang"], ["down", "word"], "rank", "n_ranked").select("lang", "word", "f", "rank"), "ranks")
    often.small = scratch.small_enough(often, SENT_WORDS)
    met = words.select("block", "lang", "code", "word").join(_sent(often.select("lang", "word", "rank"), often.small), ["lang", "word"])
    # A block has as many words as its bytes allow, so the list is bounded.
    known = met.groupBy("block").agg(F.collect_list(F.struct("code", "rank")).alias("known"))
    parts = scratch.stored(_fragments(blocks.select("block", "lang", "codes", "n_codes").join(known, "block")), "fragments")
    return scratch.stored(_mined(parts, least).drop("pivot"), "phrases"), often, sizes


def _sent(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """Each language's first phrases by score: lang, rank, phrase, a (its occurrences), l, r (those of its parts), n (words of the language), score.

    A phrase of two or three words is cut in two where the score floor(1000000 * a * a / (l * r)) is lowest, ties where the
    first part is shortest. Phrases that lie in a longer one with share percent or more of their occurrences are dropped.
    Ties: by a, then by the phrase's bytes. Null texts are empty, a null lang is und. Repeated rows count each, texts are
    read whole. Other columns of docs play no part. An empty table gives none. Exact up to 10^15 occurrences of a phrase.
    """
    phrases, often, sizes = counted(docs, text=text, lang=lang, least=least)
    scored = phrases
    for i in (1, 2, 3):
        word = often.select("lang", F.col("rank").alias(f"w{i}"), F.col("f").alias(f"f{i}"), F.col("word").alias(f"word{i}"))
        scored = scored.join(_sent(word, often.small), ["lang", f"w{i}"], "left" if i == 3 else "inner")
    scored = scratch.stored(scored, "phrases")
    two, three = scored.where("w3 < 0"), scored.where("w3 >= 0")
    pair = two.select("lang", "w1", "w2", "a")
    first = pair.withColumnRenamed("a", "f12")
    last = pair.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    three = three.join(first, ["lang", "w1", "w2"]).join(last, ["lang", "w2", "w3"])
    of = lambda a, l, r: F.expr(f"(cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))")  # noqa: E731, E741
    cut = lambda k, l, r: F.struct(of("a", l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))  # noqa: E731, E741
    three = three.select("lang", "w1", "w2", "w3", "a", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), F.least(cut(1, "f1", "f23"), cut(2, "f12", "f3")).alias("cut"))
    inner = three.select("lang", "w1", "w2", "a").unionByName(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")).groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    two = two.join(inner, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    two = two.select("lang", "a", F.concat_ws(" ", "word1", "word2").alias("phrase"), cut(1, "f1", "f2").alias("cut"))
    all_ = two.unionByName(three.select("lang", "a", "phrase", "cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    return _first(all_, top).join(F.broadcast(sizes) if scratch.small_enough(sizes, 100_000) else sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _first(rows: DataFrame, top: int) -> DataFrame:
    """The first rows of each language: first those of its parts, so that no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "_part")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(scratch.table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select row_number() over () as id, lang, list_filter(regexp_split_to_array(s, '[\x20\x09]+'), lambda x: x <> '') as ws from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as s from d)),
w as materialized (select id, lang, unnest(ws) as w1, generate_subscripts(ws, 1) as i from p where len(ws) > 0),
g as materialized (select lang, w1, lead(w1, 1) over (partition by id order by i) as w2, lead(w1, 2) over (partition by id order by i) as w3 from w),
one as materialized (select lang, w1, count(*) as f from g group by all having count(*) >= 10),
two as materialized (select lang, w1, w2, count(*) as f from g where w2 is not null group by all having count(*) >= 10),
three as materialized (select lang, w1, w2, w3, count(*) as f from g where w3 is not null group by all having count(*) >= 10),
n as (select lang, count(*) as n from g group by lang),
cuts as (select two.lang, w1 || ' ' || two.w2 as phrase, two.f as a, 1 as first_words, x.f as l, y.f as r from two join one x using (lang, w1) join (select lang, w1 as w2, f from one) y using (lang, w2)
  where not exists (select 1 from three t where t.lang = two.lang and (t.w1 = two.w1 and t.w2 = two.w2 or t.w2 = two.w1 and t.w3 = two.w2) and 100 * t.f >= 50 * two.f)
  union all select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f from three t join one x on x.lang = t.lang and x.w1 = t.w1 join two y on y.lang = t.lang and y.w1 = t.w2 and y.w2 = t.w3
  union all select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f from three t join two x on x.lang = t.lang and x.w1 = t.w1 and x.w2 = t.w2 join one y on y.lang = t.lang and y.w1 = t.w3),
s as (select *, (1000000::hugeint * a * a // (l::hugeint * r))::bigint as score from cuts),
b as (select * from (select *, row_number() over (partition by lang, phrase order by score, first_words) as k from s) where k = 1),
o as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from b join n using (lang))
select * from o where rank <= 2000
"""
