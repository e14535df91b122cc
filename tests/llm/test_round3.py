"""Collocations, the Merkle manifest and the quality classifier against brute force, and cases that were wrong before."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import collocations, graph_ann, html_tree, langid, merkle, nb_svm, pii, places, samples, scratch

DATA = "/root/testdata"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, place string, tree int, score string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(spark, tmp_path, rows, schema=DOCS, name="documents"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


# Collocations


def brute_collocations(rows, least=10, share=50, top=2000):
    grams, size = {}, Counter()
    for text, lang in rows:
        lang, t = lang if lang is not None else "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            ws = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(ws)
            for k in (1, 2, 3):
                grams.setdefault(lang, Counter()).update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = set()
    for lang, f in grams.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in cand.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    inside[q] = max(inside.get(q, 0), a)
        scored = []
        for p, a in cand.items():
            if 100 * inside.get(p, 0) >= share * a:
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, i, phrase.decode(), -a, l, r, size[lang], -score))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(collocations, "BLOCK", 700)  # many blocks; texts are cut between pieces
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "été", "中文", "a-b", "=", "x" * 40, *(f"w{i}" for i in range(15))]
    text = lambda n: "".join(rng.choice(words[: rng.choice((4, 8, 26))]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", "!"]) for _ in range(n))
    rows = [(text(rng.randrange(80)), rng.choice(["en", "de", None])) for _ in range(120)]
    rows += [(None, "en"), ("", "en"), (" \t..", "fr"), ("the the the the the " * 200, "en"), ("new york city " * 300, "en"), ("new york", "zz")] + [("of the new york", None)] * 12
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("rank", F.lit("x")).repartition(3)
    got = {tuple(r) for r in collocations.collocations(docs, top=40).collect()}
    assert got == brute_collocations(rows, top=40)
    none = collocations.collocations(docs.limit(0))
    assert none.count() == 0 and none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_every_phrase_has_one_pivot():
    rng = np.random.default_rng(0)
    ranks = rng.integers(-1, 6, 4000)
    rows, counts = collocations.fragments(ranks)
    got = Counter()
    for (p, l2, l1, r1, r2), n in zip(rows.T.tolist(), counts.tolist()):
        for gram in ((l1, p), (p, r1), (l2, l1, p), (l1, p, r1), (p, r1, r2)):
            if min(gram) >= 0:
                got[gram] += n
    want = Counter(tuple(g) for k in (2, 3) for i in range(len(ranks) - k + 1) if min(g := ranks[i : i + k].tolist()) >= 0)
    assert got == want


def test_score_is_exact_past_64_bits(spark):
    big = 9_999_999_999_999
    row = spark.createDataFrame([(big, big + 1, big + 3)], "a bigint, l bigint, r bigint")
    of = "(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    assert row.selectExpr(of).first()[0] == 1_000_000 * big * big // ((big + 1) * (big + 3))


# Merkle manifest


def brute_merkle(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> set of the query's rows."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(*map(field, r))

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def steps(levels, i):
        for nodes in levels[:-1]:
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            yield run[: i % 8], run[i % 8 + 1 :]
            i //= 8

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    levels = {x: up([leaf(r) for r in rs]) for x, rs in trees.items()}
    top = up([levels[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(trees[x]):
            path = [*steps(levels[x], i), *steps(top, k)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            at = leaf((*r[:4], r[4] and re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))) if changed else leaf(r)
            for left, right in path:
                at = sha(*left, at, *right)
            proof = sha(*[d for left, right in path for d in (*left, *right)])
            out.append((r[0], leaf(r), levels[x][-1][0], top[-1][0], proof, at, at == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["many", "one language", "one row", "many languages"])
def test_manifest_equals_brute_force(spark, tmp_path, kind):
    rng = random.Random(4)
    lang = {"many": lambda: rng.choice(["en", "en", "de", None, "é", "zz"]), "one language": lambda: "en", "one row": lambda: None, "many languages": lambda: f"l{rng.randrange(90)}"}[kind]
    n = 1 if kind == "one row" else 600
    rows = [(rng.choice([i, i, 7, None]), rng.choice(["s", None]), lang(), rng.choice([3, None]), rng.choice(["Ab c", "abc", "", None, "É A" * 2000])) for i in range(n)]
    if kind == "many":
        rows += [rows[5]] * 20 + [(1, "s", "solo", 1, "ONE")]
    path = written(spark, tmp_path, [(d, t, x, s, c, "p", 1, "q") for d, s, x, c, t in rows])
    got = sorted((tuple(r) for r in merkle.op12_merkle(spark, path).collect()), key=str)
    assert got == brute_merkle(rows)


def test_manifest_of_no_rows(spark, tmp_path):
    assert merkle.op12_merkle(spark, written(spark, tmp_path, [])).count() == 0


def test_places_over_many_ranges(spark):
    rows = [(g, v) for g, v in itertools.product("ab", range(300))] + [("hot", None)] * 700
    random.Random(1).shuffle(rows)
    got = places.placed(scratch.stored(spark.createDataFrame(rows, "g string, v int"), "rows"), ["g"], ["v"], "at", "total", each=50).collect()
    for g, n in (("a", 300), ("b", 300), ("hot", 700)):
        mine = sorted((r["at"], r.v) for r in got if r.g == g)
        assert [a for a, _ in mine] == list(range(n)) and {r.total for r in got if r.g == g} == {n}
        assert g == "hot" or [v for _, v in mine] == list(range(n))


# Quality classifier


def test_classifier_held_out(spark):
    path = f"{DATA}/sf0.01"
    out = nb_svm.op13_quality_classifier(spark, path)
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality")
    r = out.where("held_out").join(labels, "doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("quality")).alias("k"), F.count_if((F.col("quality") == 1) & (F.col("predicted") == 0)).alias("lost")).first()
    assert r.n > 50 and r.k >= 0.95 * r.n and r.lost <= 0.02 * r.n
    assert out.where("score < 0 or score > 1 or isnan(score)").count() == 0 and out.count() == 1000


def test_dual_descent_reaches_the_optimum():
    """Margins are 1 where a dual variable is between its bounds, at least 1 where it is 0, and at most 1 where it is at its upper one."""
    rng = np.random.default_rng(5)
    vectors = []
    for i in range(200):
        at = np.unique(rng.choice(np.arange(40) + (12 if i % 2 else 0), 12))
        vectors.append((at, rng.normal(size=len(at)) * 0.2 + 1, 2 * (i % 2) - 1))
    bound = np.full(200, 0.3)
    w, b, dual = nb_svm.descended(vectors, bound, rng, 5000, 1e-7)
    margin = np.array([y * (w[at] @ x + b) for at, x, y in vectors])
    free = (dual > 1e-9) & (dual < 0.3 - 1e-9)
    assert free.any() and np.abs(margin[free] - 1).max() < 1e-4 and (margin[dual <= 1e-9] > 1 - 1e-4).all() and (margin[dual >= 0.3 - 1e-9] < 1 + 1e-4).all()
    assert (dual >= 0.3 - 1e-9).any() and (dual <= 1e-9).any()


def test_classifier_cases(spark, tmp_path):
    good, bad = "plain words in a row of prose that goes on", "$$$ BUY ### NOW %%% WIN ***"
    rows = [(i, f"{good if i % 2 else bad} {i}", "en", "s", 1, "p", 1, "old") for i in range(200)] + [(300, None, None, None, None, None, None, None), (301, "", "en", "s", 1, "p", 1, "old"), (None, good, "en", "s", 1, "p", 1, "old")]
    rows += [(3, bad + " repeated", "en", "s", 1, "p", 1, "old")] * 400
    path = written(spark, tmp_path, rows)
    written(spark, tmp_path, [(i, i % 2) for i in range(200)] + [(300, None), (5, 0), (999, 1), (None, 1), (7, 2)], "doc_id bigint, quality int", "labels")
    out = nb_svm.op13_quality_classifier(spark, path).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and by[300].score == by[301].score and by[None].held_out is False and by[None].predicted == 1
    assert all(by[i].predicted == i % 2 for i in range(10, 200))
    docs = spark.createDataFrame(rows, DOCS)
    model = nb_svm.Model(np.zeros(1 << nb_svm.BITS), 0.0)
    kept = nb_svm.scored(docs, model)
    assert kept.columns == [*[c for c in docs.columns if c != "score"], "score"] and dict(kept.dtypes)["score"] == "double"
    assert nb_svm.scored(docs.limit(0), model).count() == 0
    text = "ab CD 12 é " * 300_000  # over several parts
    assert len(nb_svm.features(text)) and nb_svm.features("") .size == 0


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)]])
def test_classifier_with_less_than_two_classes(spark, tmp_path, labels):
    path = written(spark, tmp_path, [(i, "word", "en", "s", 1, "p", 1, "q") for i in range(5)])
    written(spark, tmp_path, labels, "doc_id bigint, quality int", "labels")
    assert all(0 <= r.score <= 1 for r in nb_svm.op13_quality_classifier(spark, path).collect())


# What was wrong before


def test_a_language_of_few_ids_and_many_rows_is_learned(spark):
    free = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5][:4]
    rows = [(free[i % 4], f"zzq qqz {i}", "xx") for i in range(20_000)] + [(100 + i, f"the cat and the dog {i}", "en") for i in range(600)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.langs == ["en", "xx"] and model.predict("zzq qqz qzz")[0] == "xx"


def test_signs_without_letters_are_und():
    model = langid.fit([("the cat", "en"), ("le chat", "fr")] * 10)
    assert model.predict("²½ ①") == ("und", 0.0) and model.predict("ª ½")[0] != "und"


def test_chosen_ids_are_bounded_and_distinct(spark):
    rows = spark.createDataFrame([(i % 500, i % 2) for i in range(5000)], "doc_id bigint, y int")
    got = samples.chosen(rows, "y", 50, samples.classes_of(rows, "y")).collect()
    assert len(got) == 100 and len({(r.doc_id, r.y) for r in got}) == 100


def test_formulas_and_fallbacks_stay_in_the_article():
    page = html_tree.Page("<article><p>We know that <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x = 2</annotation></math> holds, <object>see the text</object> and <svg><title>t</title><text>label</text></svg>.</p><noscript><p>Still shown</p></noscript><svg><g><p>Closed by a block</article>")
    assert [t for _, t in page.blocks] == ["We know that x=2 holds, see the text and label.", "Still shown", "Closed by a block"]


@pytest.mark.parametrize("text", ["a" * 100 + "@example.com", "x" * 5000 + ".Y@mail.example.org", "1-800-555-0199", "(020) 7946 0958", "2020/01/02", "..a.b@x.de"])
def test_values_that_stayed_in_clear(text):
    new, spans = pii.Pseudonymiser(b"k").text(f"see {text} there")
    (kind, at, n), shape = spans[0], lambda s: re.sub("[0-9]", "0", re.sub("[a-zA-Z]", "a", s))
    assert len(spans) == 1 and shape(new) == shape(f"see {text} there") and n == len(text.lstrip(".")) and new[at : at + n] != text.lstrip(".")


def test_long_addresses_are_one_to_one():
    p = pii.Permuter(b"k")
    texts = ["".join(c) + "z" * 100 + "".join(d) for c in itertools.product("ab", repeat=3) for d in itertools.product("ab", repeat=2)]
    assert len({p.text(t, "local") for t in texts}) == len(texts)


@pytest.mark.parametrize("rows", [8192, 1500])
def test_recall_of_parallel_vectors_and_several_shards(spark, rows):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(120, 24))[:, None, :] * rng.uniform(0.1, 5, size=(120, 40, 1))).reshape(-1, 24)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = graph_ann.search(graph_ann.build_index(graph_ann.nodes_of(df, 5), shard_rows=rows), graph_ann.nodes_of_queries(df.where("vec_id % 50 = 0")), k=5).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for r in got:
        near = u @ u[r.query_id]
        near[r.query_id] = -9
        hits += near[r.vec_id] >= np.sort(near)[-5] - 1e-12
    assert len(got) == 96 * 5 and hits >= 0.95 * len(got)
