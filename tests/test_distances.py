"""Distances and alignments by bits against tables filled cell by cell."""

import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import distances, moves, text


def table(a, b, edit):
    n, m = len(a), len(b)
    t = [[i + j if edit and not (i and j) else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if edit:
                t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            else:
                t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t


def walked(a, b):
    t, i, j, out = table(a, b, False), len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif t[i - 1][j] >= t[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


@pytest.mark.parametrize("kinds", [1, 2, 5, 40])
@pytest.mark.parametrize("most", [6, 45, 150])
def test_equal_to_tables(kinds, most):
    rng = random.Random(kinds * 1000 + most)
    for _ in range(1500 // most):
        a, b = ([rng.randrange(kinds) for _ in range(rng.randrange(most))] for _ in range(2))
        assert distances.edits(a, b) == table(a, b, True)[-1][-1]
        assert distances.common(a, b) == walked(a, b) == moves.aligned(a, b)


def test_long_sequences_with_repeats():
    rng = random.Random(3)
    a, b = ([rng.randrange(30) for _ in range(n)] for n in (700, 640))
    assert distances.edits(a, b) == table(a, b, True)[-1][-1] and distances.common(a, b) == walked(a, b)


def test_twenty_thousand_words_and_ten_thousand_moves():
    rng = random.Random(1)
    a, b = ([rng.randrange(3000) for _ in range(20_000)] for _ in range(2))
    began = time.perf_counter()
    distances.edits(a, b)
    assert time.perf_counter() - began < 4
    a, b = ([rng.randrange(64) for _ in range(10_000)] for _ in range(2))
    tracemalloc.start()
    pairs = distances.common(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000 and all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_columns(spark):
    rows = spark.createDataFrame([(["x", "y"], ["y"], "kitten" * 400, "sitting" * 400), ([], [], "", ""), (None, ["a"], None, "a"), (["été", "中"], ["中", "été", "é"], "é" * 2500, "e" * 2500)], "a array<string>, b array<string>, s string, t string")
    got = rows.repartition(3).select("a", "b", "s", "t", distances.word_edits("a", "b").alias("w"), distances.char_edits("s", "t").alias("c"), text.char_similarity(F.col("s"), F.col("t")).alias("sim")).collect()
    for r in got:
        assert r.w == (None if r.a is None else table(r.a, r.b, True)[-1][-1])
        if r.s is None:
            assert r.c is None
        elif len(r.s) != 2400:
            assert r.c == (2500 if r.s else 0) and r.sim == (0.0 if r.s else 1.0)
        else:
            want = spark.createDataFrame([(r.s, r.t)], "s string, t string").select(F.levenshtein("s", "t")).first()[0]
            assert r.c == want and abs(r.sim - (1 - want / 2800)) < 1e-12


def test_words_of_a_batch_by_slices(spark, monkeypatch):
    import pyarrow as pa

    from tallyloom.functions import distances, text

    a, b = [["x", "y"] * (i % 40) for i in range(300)] + [None, [], ["z"] * 900], [["y", "x"] * (i % 30) for i in range(300)] + [["q"], None, ["z"]]
    given = [pa.array(x, pa.list_(pa.string())).slice(5) for x in (a, b)]
    got, sizes, whole = [], [], distances._numbered
    monkeypatch.setattr(distances, "AT_ONCE", 500)
    monkeypatch.setattr(distances, "_numbered", lambda x, y: sizes.append((len(x), len(x.flatten()) + len(y.flatten()))) or whole(x, y))
    got = [None if x is None or y is None else distances.edits(x, y) for x, y in distances.numbered(*given)]
    assert got == [None if x is None or y is None else distances.edits(x, y) for x, y in zip(a[5:], b[5:])]
    assert sum(n for n, _ in sizes) == len(a) - 5 and all(words <= 500 or rows == 1 for rows, words in sizes) and len(sizes) > 10
    assert list(distances.numbered(given[0][:0], given[1][:0])) == []
    texts = [None if i % 7 == 0 else f"Привет {i}, {'мир ' * (i % 5)}ﬁn" for i in range(text.AT_ONCE * 3 + 1)]
    rows = spark.createDataFrame(enumerate(texts), "i int, t string").coalesce(1)
    assert [r.w for r in rows.select("i", text._exact_words("t").alias("w")).orderBy("i").collect()] == [None if t is None else text._words(t) for t in texts]
