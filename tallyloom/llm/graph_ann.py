"""Approximate nearest neighbours by cosine, with a robust-pruned directed graph in each shard.

Rows are dealt to shards of a bounded size by a hash. In a shard, every vector's greedy search from the entry point
proposes neighbours; relaxed distance pruning keeps diverse edges, and edges are also put back from the neighbours.
A beam search of each shard then answers the queries, in blocks, and the best of all shards, scored exactly on the
original vectors, are the result. A node is a direction: vectors that point the same way, of whatever lengths, share one,
and equal vectors are told once with all their ids, so neither, however many, fill the graph or hide each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

SHARD_ROWS = 8192
DEGREE, BEAM, RELAX = 32, 96, 1.2
SEARCH_BEAM = 192
#: Queries that a task searches a shard for, and those whose beams move in step.
QUERY_BLOCK, IN_STEP = 65_536, 512


def _beam(points: np.ndarray, edges: np.ndarray, entry: np.ndarray, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the nearest width nodes that a beam search reaches (-1 where fewer), by falling similarity.

    All queries move in step: each takes its best node not yet opened and looks at its neighbours.
    """
    q, n = len(queries), len(points)
    every = np.arange(q)[:, None]
    ids = np.full((q, width), -1, np.int32)
    sims = np.full((q, width), -np.inf, np.float32)
    start = entry[:width]
    ids[:, : len(start)] = start
    sims[:, : len(start)] = queries @ points[start].T
    opened = ids < 0
    seen = np.zeros((q, n + 1), bool)  # the last column takes what is missing
    seen[:, start] = True
    seen[:, n] = True
    active = np.arange(q)
    while len(active):
        todo = np.where(opened[active], -np.inf, sims[active])
        best = todo.argmax(axis=1)
        going = todo[np.arange(len(active)), best] > -np.inf
        active, best = active[going], best[going]
        if not len(active):
            break
        opened[active, best] = True
        near = edges[ids[active, best]]
        new = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        got = np.einsum("qrd,qd->qr", points[np.minimum(near, n - 1)], queries[active])
        got[~new] = -np.inf
        all_ids = np.concatenate([ids[active], np.where(new, near, -1)], axis=1)
        all_sims = np.concatenate([sims[active], got], axis=1)
        all_open = np.concatenate([opened[active], ~new], axis=1)
        keep = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        rows = np.arange(len(active))[:, None]
        ids[active], sims[active], opened[active] = all_ids[rows, keep], all_sims[rows, keep], all_open[rows, keep]
    del every
    return ids, sims


def _prune(points: np.ndarray, who: np.ndarray, cand: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Up to degree of each row's candidates: the nearest, then those that no kept one is relax times nearer to. n is 'none'."""
    n = len(points)
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
    cand[cand == who[:, None]] = n
    p = points[np.minimum(cand, n - 1)]
    d = np.maximum(0, 1 - np.einsum("qcd,qd->qc", p, points[who]))
    d[cand >= n] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    rows = np.arange(len(who))[:, None]
    cand, d, p = cand[rows, order], d[rows, order], p[rows, order]
    between = np.maximum(0, 1 - p @ p.transpose(0, 2, 1))  # squared distances halve to these, so relax counts squared
    alive = np.isfinite(d)
    out = np.full((len(who), degree), n, np.int32)
    kept = np.zeros(len(who), np.int64)
    for j in range(cand.shape[1]):
        take = np.flatnonzero(alive[:, j] & (kept < degree))
        if not len(take):
            continue
        out[take, kept[take]] = cand[take, j]
        kept[take] += 1
        alive[take] &= relax * relax * between[take, j] > d[take]
    return out


def build(points: np.ndarray, *, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n x degree, n for none) and entry points of a graph over unit vectors, in batches that double up to 512."""
    n = len(points)
    edges = np.full((n, degree), n, np.int32)
    order = np.random.default_rng(seed).permutation(n)
    middle = int((points @ points.mean(axis=0)).argmax()) if n else 0
    entry = np.unique(np.concatenate([[middle], order[:15]]))[: max(1, min(16, n))].astype(np.int32)
    done, size = len(entry), 16
    first = entry.astype(np.int64)
    edges[first] = _prune(points, first, np.tile(entry, (len(entry), 1)).astype(np.int64), degree, relax)
    order = order[~np.isin(order, entry)]
    for relaxed in (relax,):
        at = 0
        while at < len(order):
            who = order[at : at + size]
            at, size = at + size, min(512, 2 * size)
            found, _ = _beam(points, edges, entry, points[who], beam)
            cand = np.where(found < 0, n, found).astype(np.int64)
            cand = np.concatenate([cand, np.tile(who[:8], (len(who), 1))], axis=1)  # a few of the batch itself
            edges[who] = _prune(points, who, cand, degree, relaxed)
            src, dst = np.repeat(who, degree), edges[who].ravel()
            src, dst = src[dst < n], dst[dst < n]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            to, begin, count = np.unique(dst, return_index=True, return_counts=True)
            back = np.full((len(to), min(int(count.max()), 64)) if len(to) else (0, 1), n, np.int64)
            place = np.arange(len(dst)) - np.repeat(begin, count)
            fits = place < back.shape[1]
            back[np.repeat(np.arange(len(to)), count)[fits], place[fits]] = src[fits]
            for a in range(0, len(to), 512):
                edges[to[a : a + 512]] = _prune(points, to[a : a + 512].astype(np.int64), np.concatenate([edges[to[a : a + 512]].astype(np.int64), back[a : a + 512]], axis=1), degree, relaxed)
        done += len(order)
    return edges, entry


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def directions(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of vectors in which those of a direction, to about four digits, are together, and where each direction begins.

    Directions are in the order of their first vectors.
    """
    _, first, which = np.unique(np.round(_unit(points) * 1e4).astype(np.int32), axis=0, return_index=True, return_inverse=True)
    place = np.empty(len(first), np.int64)
    place[np.argsort(first)] = np.arange(len(first))
    which = place[which.ravel()]
    order = np.argsort(which, kind="stable")
    return order, np.searchsorted(which[order], np.arange(len(first))).astype(np.int64)


def nodes_of(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct vectors (dim, vec as little-endian doubles) and their k + 1 smallest ids, in rising order.

    Null, zero and non-finite vectors, and null ids, take no part. Each task first keeps the least ids of each vector, so
    of any number of copies only k + 1 ids from each task meet.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, list[int]] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or v is None or any(x is None for x in v):
                    continue
                a = np.asarray(v, dtype="<f8") + 0.0  # no negative zeros
                if not len(a) or not np.isfinite(a).all() or not a.any():
                    continue
                ids = least.setdefault(a.tobytes(), [])
                ids.append(i)
                if len(ids) > 4 * (k + 1):
                    least[a.tobytes()] = sorted(set(ids))[: k + 1]
            if len(least) > 50_000:
                yield made(least)
                least = {}
        if least:
            yield made(least)

    def made(least: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"vec": pa.array(list(least), pa.binary()), "ids": pa.array([sorted(set(x))[: k + 1] for x in least.values()], pa.list_(pa.int64()))})

    parts = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>")).mapInArrow(local, "vec binary, ids array<bigint>")
    return parts.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))


def build_index(nodes: DataFrame, *, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each shard: shard, dim, vectors, ids, starts (of each node's vectors), edges, entry. Every vector is in one.

    nodes: vec and ids. An empty table gives an index without shards, other columns play no part, vectors of any length are read
    whole and form shards with their like.
    """
    sized = nodes.select("vec", "ids", (F.length("vec") / 8).cast("int").alias("dim"))
    count = sized.count()
    shards = max(1, -(-count // shard_rows))
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))

    def graph(key: tuple[pa.Scalar, ...], whole: pa.Table) -> pa.Table:
        vec = whole.column("vec").to_pylist()
        order = sorted(range(len(vec)), key=vec.__getitem__)
        points = np.frombuffer(b"".join(vec[i] for i in order), "<f8").reshape(len(vec), -1)
        by, starts = directions(points)
        order, points = [order[i] for i in by], points[by]
        edges, entry = build(_unit(points[starts]))
        ids = [whole.column("ids")[i].as_py() for i in order]
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()), "vectors": pa.array([points.tobytes()], pa.binary()), "ids": pa.array([ids], pa.list_(pa.list_(pa.int64()))),
            "starts": pa.array([starts.astype("<i8").tobytes()], pa.binary()), "edges": pa.array([edges.astype("<i4").tobytes()], pa.binary()), "entry": pa.array([entry.astype("<i4").tobytes()], pa.binary()),
        })

    schema = "shard int, dim int, vectors binary, ids array<array<bigint>>, starts binary, edges binary, entry binary"
    return scratch.stored(dealt.groupBy("shard", "dim").applyInArrow(graph, schema), "graph")


def search(index: DataFrame, queries: DataFrame, *, k: int = 5, beam: int = SEARCH_BEAM) -> DataFrame:
    """queries (query_id, vec) against all shards: query_id, rank, vec_id, score. A query's own id is no candidate.

    Ties go to the smaller vec_id. Vectors of another length are no candidates. Repeated queries give one result. An empty index,
    or no queries, gives no rows; other columns of queries play no part.
    """
    own = queries.select("query_id", "vec", (F.length("vec") / 8).cast("int").alias("dim"))
    blocks = max(1, -(-own.count() // QUERY_BLOCK))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    # Queries go to the shards, which stay whole: a shard is copied once for QUERY_BLOCK queries, and a query once for SHARD_ROWS vectors.
    asked = own.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            row = left.slice(0, 1).to_pylist()[0]
            exact = np.frombuffer(row["vectors"], "<f8").reshape(len(row["ids"]), -1)
            norm = np.linalg.norm(exact, axis=1)
            starts = np.append(np.frombuffer(row["starts"], "<i8"), len(exact))
            points, entry = _unit(exact[starts[:-1]]), np.frombuffer(row["entry"], "<i4")
            edges = np.frombuffer(row["edges"], "<i4").reshape(len(points), -1)
            for at in range(0, right.num_rows, IN_STEP):
                part = right.slice(at, IN_STEP)
                names = part.column("query_id").to_pylist()
                q = np.frombuffer(b"".join(part.column("vec").to_pylist()), "<f8").reshape(len(names), -1)
                found, _ = _beam(points, edges, entry, _unit(q), beam)
                for j, name in enumerate(names):
                    node = found[j][found[j] >= 0]
                    size = starts[node + 1] - starts[node]
                    here = np.repeat(starts[node] - np.cumsum(size) + size, size) + np.arange(size.sum())  # all vectors of the nodes
                    score = (exact[here] @ q[j]) / (norm[here] * np.linalg.norm(q[j]))
                    near = [(-s, i) for a, s in zip(here.tolist(), score.tolist()) for i in row["ids"][a] if i != name]
                    out += [(name, i, -s) for s, i in sorted(near)[:k]]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    met = held.groupBy("shard", "dim", "block").cogroup(asked.groupBy("shard", "dim", "block")).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    found = met.dropDuplicates(["query_id", "vec_id"])
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark, sf_dir: str) -> DataFrame:
    vectors = scratch.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nodes = scratch.stored(nodes_of(vectors, 5), "nodes")
    wide = vectors.where("vec_id % 50 = 0")
    asked = nodes_of_queries(wide)
    return search(build_index(nodes), asked, k=5)


def nodes_of_queries(rows: DataFrame) -> DataFrame:
    """query_id, vec of the rows that may be asked for."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, np.asarray(v, dtype="<f8") + 0.0) for i, v in zip(*(batch.column(c).to_pylist() for c in (0, 1))) if v is not None and len(v) and not any(x is None for x in v)]
            out = [(i, a.tobytes()) for i, a in out if np.isfinite(a).all() and a.any()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([a for _, a in out], pa.binary())], names=["query_id", "vec"])

    return rows.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>")).mapInArrow(packed, "query_id bigint, vec binary")
