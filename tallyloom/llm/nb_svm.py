"""Quality classifier: a Naive Bayes support vector machine over n-grams.

Which n-grams a text has is all that counts, not how often. Each is scaled by the logarithm of the ratio of its shares
in the classes, and a linear model with hinge loss is fitted to the scaled indicators by dual coordinate descent.
N-grams are of bytes, of words, and of the shapes of words, hashed to one space. A logistic curve over the margin, fitted
on rows kept out of the training, makes scores of margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import samples, scratch, workers

BITS = 18
#: Bytes of a text that are looked at together; n-grams don't reach over from one part of a very long text to the next.
PART = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = _CLASS[128:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def _slots(codes: np.ndarray, family: int) -> np.ndarray:
    return ((codes + np.uint64(family)) * _ODD >> np.uint64(64 - BITS)).astype(np.int32)


def _hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each run of values that begins at one of starts."""
    if not len(starts):
        return np.empty(0, np.uint64)
    at = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    powers = np.cumprod(np.full(int(at.max()) + 1, _ODD))
    return np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * powers[at], starts)


def _joined(hashes: np.ndarray, n: int) -> np.ndarray:
    out = hashes
    for k in range(1, n):
        out = out[:-1] * np.uint64(0x100000001B3) ^ hashes[k:]
    return out


def features(text: str) -> np.ndarray:
    """The n-grams that a whole text has: of one to four bytes, one or two words, one to three shapes of words; ascending, hashed.

    A shape has a sign for each run of small or capital letters or digits, and other characters as they are; that of
    a word that is the same as the one before it is one of its own.
    """
    data = text.encode("utf-8", "surrogatepass")
    has = np.zeros(1 << BITS, bool)
    for at in range(0, len(data), PART):
        raw = np.frombuffer(data[at : at + PART], np.uint8)
        code = np.zeros(len(raw), np.uint64)
        for n in range(1, 5):
            if len(raw) >= n:
                code = code[: len(raw) - n + 1] << np.uint64(8) | raw[n - 1 :]
                has[_slots(code, n)] = True
        inside = ~_SPACE[raw]
        first = inside & ~np.concatenate(([False], inside[:-1]))
        words = _hashes(raw[inside], np.flatnonzero(first[inside]))
        kind = _CLASS[raw]
        edge = inside & (first | (kind != np.concatenate((kind[:1], kind[:-1]))))
        shapes = _hashes(kind[edge], np.flatnonzero(first[edge]))
        shapes[1:][words[1:] == words[:-1]] = 1
        for family, (hashes, most) in enumerate(((words, 2), (shapes, 3))):
            for n in range(1, most + 1):
                if len(hashes) >= n:
                    has[_slots(_joined(hashes, n), 10 + 5 * family + n)] = True
    eights = has.reshape(-1, 8)  # most are empty
    some = np.flatnonzero(eights.view(np.uint64).ravel())
    at, k = np.nonzero(eights[some])
    return (some[at] * 8 + k).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, at: np.ndarray) -> float:
        return float(self.weights[at].sum()) / (len(at) or 1) ** 0.5 + self.bias

    def score(self, text: str | None) -> float:
        """Between 0 and 1, higher where class 1 is likelier; a null text counts as empty."""
        z = self.slope * self.margin(features(text or "")) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def descended(vectors: list[tuple[np.ndarray, np.ndarray, int]], bound: np.ndarray, rng: np.random.Generator, epochs: int, eps: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of the linear model with the least hinge loss and squared weights.

    vectors: places, values and side (1 or -1) of each. One dual variable at a time moves to its best value between 0 and its
    bound, until none moves the margin by eps in a round.
    """
    w, b, dual = np.zeros(1 << BITS), 0.0, np.zeros(len(vectors))
    square = [float(x @ x) + 1 for _, x, _ in vectors]
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(vectors)):
            at, x, y = vectors[i]
            slope = y * (w[at] @ x + b) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), bound[i])
            step = new - dual[i]
            if step:
                w[at] += step * y * x
                b += step * y
                dual[i] = new
                worst = max(worst, abs(step) * square[i])
        if worst < eps:
            break
    return w, b, dual


def fit(rows: list[tuple[np.ndarray, int]], *, shares: tuple[float, float] = (0.5, 0.5), c: float = 1.0, smooth: float = 1.0, blend: float = 0.25, epochs: int = 60, eps: float = 0.01, seed: int = 7) -> Model:
    """From n-grams and class (0 or 1) of each row; every fifth row of a class fits the curve instead.

    shares: of the classes where the model is used, as the rows may hold them in others. blend: the part of the fitted
    weights in the model, the rest being their mean size, which leaves the log-count ratios as they are.
    """
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    train, check, seen = [], [], [0, 0]
    for r in rows:
        (check if seen[r[1]] % 5 == 0 else train).append(r)
        seen[r[1]] += 1
    if not all(any(y == k for _, y in part) for k in (0, 1) for part in (train, check)):
        # One class, or none: the share of class 1 is all that there is to know.
        p = min(max(seen[1] / sum(seen) if sum(seen) else shares[1], 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << BITS), 0.0, 0.0, float(np.log(p / (1 - p))))
    count = [np.full(1 << BITS, smooth) for _ in (0, 1)]
    for at, y in train:
        count[y][at] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    size = [sum(y == k for _, y in train) for k in (0, 1)]
    vectors = [(at, ratio[at] / (len(at) or 1) ** 0.5, 2 * y - 1) for at, y in train]
    bound = np.array([c * len(train) / (2 * size[y > 0]) for _, _, y in vectors])
    w, b, _ = descended(vectors, bound, rng, epochs, eps)
    used = np.flatnonzero(count[0] + count[1] > 2 * smooth)
    mean = float(np.abs(w[used]).mean())
    model = Model(np.where(count[0] + count[1] > 2 * smooth, ratio * ((1 - blend) * mean + blend * w), 0.0), blend * b)
    margins = np.array([model.margin(at) for at, _ in check])
    truth = np.array([y for _, y in check], float)
    weight = np.where(truth == 1, shares[1] / truth.mean(), shares[0] / (1 - truth.mean()))
    model.slope, model.offset = _curve(margins, truth, weight)
    return model


def _curve(margins: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve with the least weighted loss, by Newton's steps on margins of unit spread.

    A small penalty on the slope keeps it finite where the classes lie apart.
    """
    spread = float(margins.std()) or 1.0
    x = np.stack([margins / spread, np.ones(len(margins))])
    theta, hold = np.zeros(2), np.diag([0.001, 1e-9]) * len(margins)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -500, 500)))
        step = np.linalg.solve((x * weight * p * (1 - p)) @ x.T + hold, x @ (weight * (p - truth)) + hold @ theta)
        step *= min(1.0, 2.0 / (np.abs(step).max() or 1.0))
        theta = theta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0] / spread), float(theta[1])


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_entries: int) -> tuple[list[tuple[np.ndarray, int]], tuple[float, float]]:
    """N-grams and class of the sample that is learned from, and the classes' shares among all labelled ids outside the held-out fold.

    The sample is chosen by ids alone: up to per_class of each class, and no more n-grams than most_entries in all. Texts are
    turned into n-grams where they are. An id with both labels teaches nothing.
    """
    free = labels.where((samples.fold(F.col("doc_id")) != 0) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").select("doc_id", F.col("y").cast("int").alias("y"))
    free = scratch.stored(free, "labels")
    counts = scratch.stored(free.groupBy("y").agg(F.count("*").alias("count")), "classes", 2)
    size = {r.y: r["count"] for r in counts.collect()}  # two at most
    some = free.join(F.broadcast(samples.chosen(free, "y", per_class, counts)), ["doc_id", "y"])
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    met = met.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "y", "x.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(g) for g in got], pa.int64()), pa.array(got, pa.list_(pa.int32()))], names=["doc_id", "y", "n", "at"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = scratch.stored(met.mapInArrow(workers.task(run), f"doc_id {kind}, y int, n bigint, at array<int>"), "ngrams")
    # As many rows as the sample has, without their n-grams, in one window.
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    kept = rows.select("doc_id", upto.alias("upto")).where(F.col("upto") <= most_entries).select("doc_id")
    got = rows.join(F.broadcast(kept), "doc_id").select("doc_id", "y", "at").toArrow().sort_by("doc_id").combine_chunks()
    total = sum(size.values()) or 1
    out = [(x.values.to_numpy(), y) for x, y in zip(got["at"], got["y"].to_pylist())]
    return out, (size.get(0, 0) / total, size.get(1, 0) / total)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int = 2000, most_entries: int = 20_000_000) -> Model:
    """Fit on a bounded sample: at most per_class labelled documents of each class outside the held-out fold, with at most most_entries n-grams.

    Documents' doc_id and text, labels' doc_id and label (0 or 1, others teach nothing) are all that is read.
    """
    rows, shares = labelled(docs, labels, label, per_class, most_entries)
    return fit(rows, shares=shares)


def scored(docs: DataFrame, model: Model, *, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a score between 0 and 1, from the text alone; a pass without a shuffle. The model's size is fixed by BITS.

    Nulls: a null text counts as empty, which has a score too. Texts are read whole, very long ones in parts of PART bytes. Repeated
    rows get the same score. A column of docs named like the score is replaced, all others stay. An empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    spots = [i for i, c in enumerate(docs.columns) if c.lower() != score.lower()]
    names = [docs.columns[i] for i in spots]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            got = pa.array([model.score(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in spots], got], names=[*names, score])

    return docs.mapInArrow(workers.task(run), docs.drop(score).withColumn(score, F.lit(0.0)).schema)


def op13_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Nulls: a null text is scored as an empty one, a null doc_id isn't held out; a null label teaches nothing. An empty table gives none."""
    docs = scratch.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, scratch.table(spark, sf_dir, "labels").select("doc_id", "quality"))
    held = docs.select("doc_id", F.coalesce(samples.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return scored(held, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
