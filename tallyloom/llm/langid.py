"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader and elastic-net penalties, then calibrated with one temperature on
rows kept out of the training. N-grams of one to three lower-case letters, with words set off by a mark, are hashed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import samples, scratch, workers

BITS = 15
ORDERS = (1, 2, 3)
_LETTER = regex.compile(r"\p{L}")
_MULT = np.uint32(2654435761)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text, and how often each occurs. Code points that aren't letters count as one mark."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    plain = (points < 128) & ((points < 97) | (points > 122))
    points = np.concatenate([[0], np.where(plain, 0, points), [0]]).astype(np.uint32)
    points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]  # runs of marks are one
    counts = np.zeros(1 << BITS, np.int64)
    code = points.copy()
    for n in ORDERS:
        if n > 1:
            if len(code) < 2:
                break
            code = code[:-1] * np.uint32(0x01000193) ^ points[n - 1 :]
        counts += np.bincount((code * _MULT + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = features(text)
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / (np.linalg.norm(x) or 1.0)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its calibrated probability; "und" and 0 for texts that are null or have no letter."""
        if not text or not _LETTER.search(text) or not self.langs:
            return "und", 0.0
        z = self.logits(*self.vector(text)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def fit(rows: list[tuple[str | tuple[np.ndarray, np.ndarray], str]], *, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 7) -> Model:
    """FTRL-proximal over the rows (text, or its features, and lang); every fifth row calibrates the temperature instead."""
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    seen = [(features(x) if isinstance(x, str) else x, langs.index(lang)) for x, lang in rows]
    train, check = [r for i, r in enumerate(seen) if i % 5], seen[::5]
    df = np.bincount(np.concatenate([at for (at, _), _ in train] or [np.empty(0, np.int64)]).astype(np.int64), minlength=1 << BITS)
    model = Model(langs, np.log((1 + len(train)) / (1 + df)) + 1, np.zeros((1 << BITS, len(langs))), np.zeros(len(langs)))

    def scaled(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * model.idf[at]
        return x / (np.linalg.norm(x) or 1.0)

    vectors = [(np.append(at, 1 << BITS), np.append(scaled(at, n), 1.0), y) for (at, n), y in train]
    z, g2 = np.zeros(((1 << BITS) + 1, len(langs))), np.zeros(((1 << BITS) + 1, len(langs)))

    def now(at: np.ndarray | slice) -> np.ndarray:
        big = np.sign(z[at]) * l1 - z[at]
        return np.where(np.abs(z[at]) <= l1, 0.0, big / ((beta + np.sqrt(g2[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(vectors)):
            at, x, y = vectors[i]
            w = now(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / alpha * w
            g2[at] += g * g
    w = now(slice(None))
    model.weights, model.bias = w[:-1], w[-1]
    if check and len(langs) > 1:
        logits = np.array([model.logits(at, scaled(at, n)) for (at, n), _ in check])
        truth = np.array([y for _, y in check])
        model.temperature = min(np.geomspace(0.05, 5, 60), key=lambda t: _loss(logits / t, truth))
    return model


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    z = z - z.max(axis=1, keepdims=True)
    return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())


def _sampled(docs: DataFrame, per_lang: int, counts: DataFrame) -> DataFrame:
    """doc_id, lang, text of up to per_lang labelled ids of each language outside the held-out fold: those with the least hashes.

    counts: lang and about how many distinct ids each has. The choice is made on ids alone; only the chosen ids' texts are read.
    An id that repeats in a language counts once, by the text that has the least hash, however many rows it has.
    """
    free = docs.where((samples.fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return samples.one_text(free, "lang", samples.chosen(free, "lang", per_lang, counts))


def sample(docs: DataFrame, per_lang: int, counts: DataFrame) -> list[tuple[str, str]]:
    """The texts and languages that are learned from."""
    return [(r.text, r.lang) for r in sorted(_sampled(docs, per_lang, counts).collect(), key=lambda r: (r.doc_id, r.lang))]


def sample_features(docs: DataFrame, per_lang: int, counts: DataFrame) -> list[tuple[tuple[np.ndarray, np.ndarray], str]]:
    """Their n-grams, counted where the texts are, so that what comes to the driver is bounded by BITS whatever the texts' length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t.as_py()) for t in batch.column(2)]
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in got], ints), pa.array([n for _, n in got], ints)], names=["doc_id", "lang", "at", "n"])

    kind = dict(docs.dtypes)["doc_id"]
    found = _sampled(docs, per_lang, counts).mapInArrow(workers.task(run), f"doc_id {kind}, lang string, at array<bigint>, n array<bigint>").collect()
    return [((np.array(r["at"], np.int64), np.array(r.n, np.int64)), r.lang) for r in sorted(found, key=lambda r: (r.doc_id, r.lang))]


def identified(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, from the text alone; a pass without a shuffle. The model's size is fixed by BITS and the languages.

    Nulls: a null text, and one without a letter, is und with score 0. Texts are read whole. Repeated rows get the same
    result; of languages that tie the first by code point is taken. Columns of docs named lang_pred or score are replaced, all
    others stay. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    out = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0))
    at = docs.columns.index(text)
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    spots = [docs.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(at)]
            cols = [batch.column(i) for i in spots] + [pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(workers.task(run), out.select(*names, "lang_pred", "score").schema)


def train(docs: DataFrame, *, per_lang: int = 400, max_langs: int = 250) -> Model:
    """Fit on a bounded sample of doc_id, text, lang: at most per_lang rows of each language. More languages than max_langs are an error."""
    free = docs.where((samples.fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull())
    counts = samples.classes_of(free, "lang")
    if not scratch.small_enough(counts, max_langs):
        raise ValueError(f"more than {max_langs} languages")
    return fit(sample_features(docs, per_lang, counts))


def op6_langid(spark, sf_dir: str) -> DataFrame:
    """Nulls: a null text is und with score 0; a null lang is never learned from; a null doc_id isn't held out. An empty table gives none."""
    docs = scratch.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs)
    held = docs.select("doc_id", F.coalesce(samples.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return identified(held, model).select("doc_id", "held_out", "lang_pred", "score")
