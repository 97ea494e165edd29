"""Approximate nearest neighbours with robust-pruned directed graphs, one for each shard.

Vectors are dealt by a hash into shards of about ``SHARD_ROWS``. A shard's graph starts at random; each vector
in turn (in batches) is searched for greedily from the medoid, and the vectors expanded on the way are its proposed
neighbours. Robust pruning keeps the nearest one, drops all that are ``ALPHA`` times nearer to it than to
the vector itself, and goes on with the next, up to ``DEGREE``; a relaxed ALPHA over 1 keeps long edges. Edges
are added backwards too, and a full vertex is pruned anew. Two rounds, the first with ALPHA 1.

Search: every block of queries meets every shard and is answered there by a beam search of width ``BEAM``; a
query's best ``k`` of all shards are its result. Distances of results are exact, in double precision, on the
original vectors. Recall is measured against brute force in the tests.

Equal vectors are one vertex with its ``k + 1`` smallest ids, which is all that a result can need. Rows that are null, empty, zero, or hold a
null or non-finite component take no part, nor do rows with a null id; repeated rows count once. A row with the
query's id is the query's own; of several rows with one id the nearest counts. Vectors of different lengths never meet. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, table

SHARD_ROWS, QUERY_ROWS = 2048, 1024
DEGREE, ALPHA, BEAM, BUILD_BEAM, BATCH = 32, 1.2, 96, 48, 256
SEED = 7


class Graph:
    """Vertices ``x`` (float32 rows), out-edges ``to`` (-1: none) and the vertex where searches begin."""

    def __init__(self, x: np.ndarray, to: np.ndarray, start: int):
        self.x, self.to, self.start, self.norm = x, to, start, np.einsum("ij,ij->i", x, x)

    def _far(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its row of vertices, less the query's own square."""
        return self.norm[at] - 2 * np.einsum("qd,qrd->qr", q, self.x[at])

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``beam`` nearest found, nearest first (-1: none), and the vertices expanded in order."""
        n, m = len(q), len(self.x)
        ids = np.full((n, beam), -1, np.int32)
        far = np.full((n, beam), np.inf, np.float32)
        done = np.ones((n, beam), bool)  # nothing to expand in an empty place
        seen = np.zeros((n, m), bool)
        ids[:, 0], done[:, 0], seen[:, self.start] = self.start, False, True
        far[:, 0] = self._far(q, ids[:, :1])[:, 0]
        path, live = [], np.arange(n)
        while len(live):
            place = done[live].argmin(axis=1)
            more = ~done[live, place]
            live, place = live[more], place[more]
            if not len(live):
                break
            done[live, place] = True
            now = ids[live, place]
            step = np.full(n, -1, np.int32)
            step[live] = now
            path.append(step)
            new = self.to[now]
            fresh = (new >= 0) & ~seen[live[:, None], new]
            new_far = np.where(fresh, self._far(q[live], new), np.inf).astype(np.float32)
            rows, cols = np.nonzero(fresh)
            seen[live[rows], new[rows, cols]] = True
            all_far = np.concatenate([far[live], new_far], axis=1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far[live] = np.take_along_axis(all_far, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, new, -1)], axis=1), best, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), best, 1)
        return ids, np.stack(path, axis=1) if path else np.empty((n, 0), np.int32)

    def prune(self, of: np.ndarray, near: np.ndarray, alpha: float, degree: int) -> np.ndarray:
        """Robust pruning of proposed neighbours ``near`` (-1: none) of the vertices ``of``."""
        out = np.full((len(of), degree), -1, np.int32)
        far = self._far(self.x[of], near) + self.norm[of][:, None]
        far = np.where((near < 0) | (near == of[:, None]), np.inf, np.maximum(far, 0))
        order = np.argsort(far, axis=1)
        near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
        x, norm = self.x[near], self.norm[near]
        left, rows = np.isfinite(far), np.arange(len(of))
        for k in range(degree):
            pick = left.argmax(axis=1)
            some = left[rows, pick]
            if not some.any():
                break
            out[some, k] = near[some, pick[some]]
            p = x[rows, pick]
            between = norm + norm[rows, pick][:, None] - 2 * np.einsum("qd,qrd->qr", p, x)
            left &= alpha * alpha * np.maximum(between, 0) > far
            left[rows, pick] = False  # also when rounding says that it is far from itself
            left &= near != near[rows, pick][:, None]
        return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> Graph:
    """The graph over distinct rows ``x``."""
    rng, m = np.random.default_rng(SEED), len(x)
    x = np.ascontiguousarray(x, np.float32)
    width = min(degree, max(1, m - 1))
    to = rng.integers(0, m, (m, width)).astype(np.int32)
    to[to == np.arange(m)[:, None]] = -1
    mean = x.mean(axis=0)
    g = Graph(x, to, int(((x - mean) ** 2).sum(axis=1).argmin()))
    if m <= degree + 1:
        g.to = np.array([[j for j in range(m) if j != i] or [-1] for i in range(m)], np.int32)
        return g
    for a in (1.0, alpha):
        order = rng.permutation(m).astype(np.int32)
        for at in range(0, m, BATCH):
            of = order[at : at + BATCH]
            _, path = g.search(x[of], beam)
            g.to[of] = g.prune(of, np.concatenate([path, g.to[of]], axis=1), a, width)
            # the same edges backwards: each target with all its new sources
            src, dst = np.repeat(of, width), g.to[of].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            ends, first = np.unique(dst, return_index=True)
            nth = np.arange(len(dst)) - np.repeat(first, np.diff(np.r_[first, len(dst)]))
            wide = np.full((len(ends), int(nth.max()) + 1), -1, np.int32)
            wide[np.searchsorted(ends, dst), nth] = src
            for i in range(0, len(ends), BATCH):
                part = ends[i : i + BATCH]
                g.to[part] = _merged(g, part, wide[i : i + BATCH], a, width)
    return g


def _merged(g: Graph, of: np.ndarray, new: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Out-edges with new ones; those that have no room for them are pruned."""
    both = np.sort(np.concatenate([g.to[of], new], axis=1), axis=1)[:, ::-1]
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    both = np.sort(both, axis=1)[:, ::-1]
    out = np.ascontiguousarray(both[:, :degree])
    full = np.flatnonzero((both >= 0).sum(axis=1) > degree)
    if len(full):
        out[full] = g.prune(of[full], both[full], alpha, degree)
    return out


# ------------------------------------------------------------------ on Spark

def usable(vec_id: Column, vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vec_id.isNotNull() & vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0)


def _distinct(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector, dim``: the rows that take part, repeated ones once, in doubles."""
    rows = vectors.where(usable(F.col("vec_id"), F.col("vector"))).select("vec_id", F.col("vector").cast("array<double>").alias("vector"))
    return rows.groupBy("vec_id", "vector").agg(F.size("vector").alias("dim"))


def _rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column("vec_id").to_numpy()
    x = np.array(t.column("vector").combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
    order = np.lexsort((*x.T[::-1], ids))  # whatever order the rows came in
    return ids[order], x[order]


INDEX = "shard long, dim int, ids binary, owner binary, vectors binary, edges binary, start int, n int"


def index(vectors: DataFrame, keep: int = 11, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each shard: its distinct vectors, the ``keep`` smallest ids of each, and the graph."""
    rows = cut_lineage(_distinct(vectors))
    shards = max(1, math.ceil(rows.count() / shard_rows))

    def built(t: pa.Table) -> pa.Table:
        ids, all_ = _rows(t)
        x, owner = np.unique(all_, axis=0, return_inverse=True)
        by = np.lexsort((ids, owner.ravel()))
        ids, owner = ids[by], owner.ravel()[by]
        nth = np.arange(len(ids)) - np.searchsorted(owner, owner)
        ids, owner = ids[nth < keep], owner[nth < keep].astype(np.int32)
        g = build(x)
        one = {"shard": t.column("shard")[0].as_py(), "dim": x.shape[1], "ids": ids.astype(np.int64).tobytes(), "owner": owner.tobytes(), "vectors": x.tobytes(), "edges": g.to.tobytes(), "start": g.start, "n": len(x)}
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
        return pa.table({k: pa.array([v], t) for (k, v), t in zip(one.items(), kinds)})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)))
    return cut_lineage(dealt.groupBy("dim", "shard").applyInArrow(built, INDEX))


def _answers(k: int, beam: int):
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def one(r: dict) -> tuple[list[int], list[int], list[float]]:
        x = np.frombuffer(r["vectors"], np.float64).reshape(r["n"], -1)
        ids, owner = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["owner"], np.int32)
        g = Graph(x.astype(np.float32), np.frombuffer(r["edges"], np.int32).reshape(r["n"], -1), r["start"])
        q_ids, q = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_vectors"], np.float64).reshape(-1, x.shape[1])
        # the query itself and rounding in single precision may take places, hence the wider cut
        near = g.search(q.astype(np.float32), beam)[0][:, : 2 * k + 2]
        first, last = np.searchsorted(owner, np.arange(r["n"])), np.searchsorted(owner, np.arange(r["n"]), side="right")
        out: tuple[list, list, list] = [], [], []
        for i, row in enumerate(near):
            row = row[row >= 0]
            score = np.sqrt(((x[row] - q[i]) ** 2).sum(axis=1))
            found = [(s, int(v)) for s, v_ in zip(score.tolist(), row.tolist()) for v in ids[first[v_] : last[v_]] if v != q_ids[i]]
            for s, v in sorted(found)[:k]:
                out[0].append(int(q_ids[i]))
                out[1].append(v)
                out[2].append(s)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cols = one({name: b.column(j)[i].as_py() for j, name in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind)], schema=kind)

    return run


def search(shards: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query (``vec_id, vector``)."""
    rows = cut_lineage(_distinct(queries))
    blocks = max(1, math.ceil(rows.count() / query_rows))

    def packed(t: pa.Table) -> pa.Table:
        ids, x = _rows(t)
        return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), "block": pa.array([t.column("block")[0].as_py()], pa.int64()), "q_ids": pa.array([ids.astype(np.int64).tobytes()]), "q_vectors": pa.array([x.tobytes()])})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)))
    packs = cut_lineage(dealt.groupBy("dim", "block").applyInArrow(packed, "dim int, block long, q_ids binary, q_vectors binary"))
    # every block meets every shard, and each such pair is a key of its own
    numbers = shards.select("shard").distinct()
    most = numbers.agg(F.max("shard")).first()[0]
    left = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = packs.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most or 0).cast("long"))))
    met = left.join(right, ["dim", "shard", "block"]).select("ids", "owner", "vectors", "edges", "start", "n", "q_ids", "q_vectors")
    found = met.mapInArrow(_answers(k, beam), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 100: ``query_id, rank, vec_id, score``."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return search(index(vectors), vectors.where("vec_id % 100 = 0"), k=10)
