"""Seeded shuffles and samples without a list of all places, against the standard library's on lists."""

import random
import tracemalloc
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import shuffles
from tallyloom.operators import sampling


@pytest.mark.parametrize("block", [1 << 16, 64])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 64, 65, 1000, 4097])
def test_first_places_equal_a_list(monkeypatch, n, block):
    monkeypatch.setattr(shuffles, "BLOCK", block)
    for seed in (42, 0, 10**12):
        rng, xs = random.Random(seed), list(range(n))
        rng.shuffle(xs)
        for k in (0, 1, 7, n // 2, n, n + 3):
            assert shuffles.first_places(shuffles.seeded(seed), n, k) == xs[:k]
            assert shuffles.first_places(shuffles.seeded(seed), n, k, k // 2) == xs[k // 2 : k]
        more = list(range(90))
        rng.shuffle(more)  # the generator goes on to the next group
        assert shuffles.first_places(shuffles.passed(shuffles.seeded(seed), n), 90, 90) == more


def test_large_shuffles_in_little_memory():
    n, xs = 300_000, list(range(300_000))
    random.Random(5).shuffle(xs)
    tracemalloc.start()
    got = shuffles.first_places(shuffles.seeded(5), n, 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == xs[:1000] and peak < 8_000_000


def test_draws_of_more_than_32_bits():
    rng, i = random.Random(5), 5_000_000_000
    drawn = shuffles._block(shuffles._generator(shuffles.seeded(5)), i)
    assert [rng._randbelow(i + 1 - t) for t in range(len(drawn))] == drawn.tolist()


@pytest.mark.parametrize("followed", [1_000_000, 3])
def test_shuffled_limit_and_stratified_equal_lists(spark, monkeypatch, followed):
    monkeypatch.setattr(sampling, "FOLLOWED", followed)
    groups = [random.Random(i).choice(["b", "a", "c", None, "rare"] if i % 40 == 0 else ["b", "a", "c", None]) for i in range(400)]
    rows = spark.createDataFrame(list(enumerate(groups)), "n int, g string").repartition(5)
    xs = list(range(400))
    random.Random(9).shuffle(xs)
    assert [r.n for r in sampling.shuffled_limit(rows, "n", 25, 9).collect()] == xs[:25]
    assert [r.n for r in sampling.shuffled_limit(rows, "n", 400, 9).collect()] == xs
    for k in (1, 30, 390):
        pools, rng = defaultdict(list), random.Random(9)
        for i, g in enumerate(groups):
            pools[g].append(i)
        for pool in pools.values():
            rng.shuffle(pool)
        want = [pools[g][depth] for depth in range(400) for g in sorted(pools, key=lambda g: (g is not None, g)) if depth < len(pools[g])][:k]
        got = sampling.stratified(rows, "g", "n", k, 9)
        assert [r.n for r in got.collect()] == want and got.columns == ["n", "g"]
    assert sampling.stratified(rows, "g", "n", 0, 9).count() == sampling.stratified(rows, "g", "n", 500, 9).count() == 400
    assert sampling.shuffled_limit(rows.where(F.lit(False)), "n", 5).count() == 0
