"""Whitening of embeddings by their leading principal components.

1. Each distinct vector counts once (the fit list). Every task sums its share exactly, and the sums of all tasks give the
   number of vectors ``n`` and the sums ``S`` of each dimension as whole numbers.
2. Every task centres its share at ``S / n`` and sums the products; the tasks' matrices are added row by row.
3. The covariance is made tridiagonal by Householder reflections. Sturm counts (how many eigenvalues lie below a number)
   bisect the leading eigenvalues; inverse iteration gives their vectors, and those of a cluster of close eigenvalues are
   made orthogonal to each other in every step. The reflections then take them back.
4. Means and components are broadcast and every row is projected.

Vectors are arrays of whole numbers (see :func:`quantised`); those of each length are whitened apart. Rows whose vector is
null or holds a null (or, before rounding, non-finite) entry are left out, empty vectors and components of no variance give
no rows, so a list of equal vectors gives none. Repeated rows count once in the fit and each get their result; a null id
is kept, other columns are left out whatever their names, and an empty table gives an empty result. Entries are limited
to 2^52 in size, where doubles are exact. ``deviation`` is null where the exact sum is beyond a long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table

#: Bytes of means and components that one broadcast may hold; the vectors of further lengths take further passes.
BROADCAST_BYTES = 16 << 20
#: Eigenvalues below this part of the largest are rounding errors of none.
LEAST = 1e-11
MODEL = "dim int, n long, mean array<double>, sums array<decimal(38,0)>, trace double, value array<double>, component array<array<double>>"


# ------------------------------------------------------------------ eigenvectors

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of ``H a H``, and the vectors of the reflections that make up ``H``."""
    a, m, reflections = a.copy(), len(a), []
    for k in range(m - 2):
        x = a[k + 1 :, k]
        scale = np.abs(x).max()
        u = np.zeros(m - k - 1)
        if np.abs(x[1:]).max(initial=0.0) > 0:
            u[:] = x / scale
            u[0] += math.copysign(np.linalg.norm(u), u[0])
            u /= np.linalg.norm(u)
            rest = a[k + 1 :, k + 1 :]
            p = 2 * (rest @ u)
            p -= (u @ p) * u
            rest -= np.outer(u, p) + np.outer(p, u)
            a[k + 1 :, k] = a[k, k + 1 :] = x - 2 * (u @ x) * u
        reflections.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def below(d: np.ndarray, e: np.ndarray, x: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm count: how many eigenvalues of the tridiagonal matrix are less than each of ``x``."""
    out, q = np.zeros(len(x), np.int64), np.ones(len(x))
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        out += q < 0
    return out


def leading(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues of the tridiagonal matrix, the largest first, by bisection."""
    m = len(d)
    radius = np.abs(np.r_[e, 0.0]) + np.abs(np.r_[0.0, e])
    size = float(np.max(np.abs(d) + radius)) or 1.0
    tiny = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, size)
    low = np.full(k, float(np.min(d - radius)) - 1e-12 * size)
    high = np.full(k, float(np.max(d + radius)) + 1e-12 * size)
    wanted = m - 1 - np.arange(k)  # the eigenvalue with so many below it
    for _ in range(120):
        mid = low + (high - low) / 2
        if ((mid <= low) | (mid >= high)).all():
            break
        less = below(d, e, mid, tiny) <= wanted
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return low + (high - low) / 2


def solved(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """``(T - shift) x = b`` for the tridiagonal matrix, by elimination with exchange of rows."""
    m, b = len(d), b.tolist()
    main, up, up2, low = (d - shift).tolist(), [*e.tolist(), 0.0], [0.0] * m, e.tolist()
    for i in range(m - 1):
        if abs(low[i]) > abs(main[i]):
            main[i], low[i] = low[i], main[i]
            up[i], main[i + 1] = main[i + 1], up[i]
            up2[i], up[i + 1] = up[i + 1], 0.0
            b[i], b[i + 1] = b[i + 1], b[i]
        if abs(main[i]) < tiny:
            main[i] = tiny
        f = low[i] / main[i]
        main[i + 1] -= f * up[i]
        up[i + 1] -= f * up2[i]
        b[i + 1] -= f * b[i]
    if abs(main[-1]) < tiny:
        main[-1] = tiny
    for i in range(m - 1, -1, -1):
        rest = (up[i] * b[i + 1] if i + 1 < m else 0.0) + (up2[i] * b[i + 2] if i + 2 < m else 0.0)
        b[i] = (b[i] - rest) / main[i]
        if abs(b[i]) > 1e150:  # grows only towards the eigenvector: what counts is its direction
            b = [v * 1e-150 for v in b]
    return np.array(b)


def vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) of the tridiagonal matrix for eigenvalues in falling order, by inverse iteration. Within
    a cluster each step is made orthogonal to the vectors before it."""
    m = len(d)
    size = float(np.max(np.abs(d)) + 2 * np.max(np.abs(e), initial=0.0)) or 1.0
    eps = np.finfo(float).eps
    rng, out, start = np.random.default_rng(0), np.zeros((len(values), m)), 0
    shift = math.inf
    for k, value in enumerate(values.tolist()):
        if k and values[k - 1] - value > 1e-3 * size:
            start = k
        # equal eigenvalues are told apart by a few units in the last place
        shift = min(value, shift - 4 * eps * size) if k > start else value
        x = rng.standard_normal(m)
        for step in range(8):
            for _ in range(2):  # twice is enough
                x -= out[start:k].T @ (out[start:k] @ x)
            x /= np.linalg.norm(x)
            if step >= 3 and np.linalg.norm(d * x + np.r_[e * x[1:], 0.0] + np.r_[0.0, e * x[:-1]] - value * x) <= 16 * eps * size * math.sqrt(m):
                break
            x = solved(d, e, shift, x, eps * size)
            x /= np.abs(x).max()
        for _ in range(2):
            x -= out[start:k].T @ (out[start:k] @ x)
        out[k] = x / np.linalg.norm(x)
    return out


def eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, and their unit eigenvectors (rows)."""
    scale = float(np.abs(a).max(initial=0.0))
    k = min(k, len(a))
    if not scale or not k:
        return np.zeros(k), np.eye(len(a))[:k]
    d, e, reflections = tridiagonal(a / scale)
    values = leading(d, e, k)
    out = vectors(d, e, values)
    for i in range(len(reflections) - 1, -1, -1):
        u = reflections[i]
        out[:, i + 1 :] -= 2 * np.outer(out[:, i + 1 :] @ u, u)
    return values * scale, out


# ------------------------------------------------------------------ on Spark

def quantised(vector: Column, scale: float, offset: int) -> Column:
    """``floor(scale * entry) + offset`` of each entry as longs, within 2^52 in size; null for a vector that is null or
    holds null or non-finite entries."""
    limit = float(2**52)
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    within = lambda v: F.greatest(F.lit(-limit), F.least(F.lit(limit), v))
    return F.when(fine, F.transform(vector, lambda v: within(F.floor(within(v.cast("double") * scale)).cast("double") + offset).cast("long")))


def _matrices(batches: Iterator[pa.RecordBatch], columns: int = 0) -> Iterator[tuple]:
    """(first columns, vectors as a matrix) for each vector length of each batch."""
    for b in batches:
        lists = b.column(columns)
        size = np.diff(np.asarray(lists.offsets))
        for dim in np.unique(size).tolist():
            at = np.flatnonzero(size == dim)
            part = lists.take(pa.array(at))
            yield [b.column(c).take(pa.array(at)) for c in range(columns)], np.asarray(part.flatten(), np.int64).reshape(len(at), dim)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each vector length of a task's share: the count and the sums, in halves of 26 bits, which cannot overflow."""
    total: dict[int, list] = {}
    for _, x in _matrices(batches):
        t = total.setdefault(x.shape[1], [0, [0] * x.shape[1]])
        t[0] += len(x)
        high, low = (x >> 26).sum(axis=0).tolist(), (x & (1 << 26) - 1).sum(axis=0).tolist()
        t[1] = [s + (h << 26) + w for s, h, w in zip(t[1], high, low)]
    rows = [(dim, n, i, str(v)) for dim, (n, s) in total.items() for i, v in enumerate(s)]
    for at in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 10_000]), (pa.int32(), pa.int64(), pa.int32(), pa.string()))], ["dim", "n", "i", "s"])


def _products(means: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for _, x in _matrices(batches):
            dim = x.shape[1]
            if dim not in means:
                continue
            c = x - means[dim]
            total[dim] = total.get(dim, 0.0) + c.T @ c
        for dim, m in total.items():
            for i, row in enumerate(m):
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([i], pa.int32()), pa.array([row], pa.list_(pa.float64()))], ["dim", "i", "row"])

    return run


def _added(t: pa.Table) -> pa.Table:
    """Rows of all tasks' matrices added up."""
    rows = np.asarray(t.column("row").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
    rows = rows[np.lexsort(rows.T[::-1])]  # whatever order they came in
    return pa.table({"dim": t.column("dim")[:1], "i": t.column("i")[:1], "row": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})


def _groups(sizes: list[tuple[int, int]], limit: int) -> list[list[int]]:
    """Vector lengths in groups of at most ``limit`` bytes (one at least)."""
    out, held = [], limit + 1
    for dim, size in sorted(sizes):
        if held + size > limit:
            out.append([])
            held = 0
        out[-1].append(dim)
        held += size
    return out


class Whitening:
    """Means, eigenvalues and components fitted to the distinct vectors of a column.

    ``model`` is a written table with a row for each vector length (``MODEL``): what the driver holds at a time are the
    rows of a few lengths, within ``limit`` bytes or of one length.
    """

    def __init__(self, vectors: DataFrame, vector: str = "x", k: int = 16, limit: int = BROADCAST_BYTES):
        self.spark, self.k, self.limit = vectors.sparkSession, k, limit
        # each distinct vector once; repeated ones are merged before the exchange
        self.fit = cut_lineage(vectors.select(F.col(f"`{vector}`").alias("x")).where("x is not null and size(x) > 0").distinct())
        sums = self.fit.mapInArrow(_sums, "dim int, n long, i int, s string").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        self.sums = cut_lineage(sums)
        dims = [(r.dim, 8 * r.dim * (k + 4)) for r in self.sums.select("dim").distinct().toLocalIterator()]
        self.groups = _groups(dims, limit)
        models = [self._fitted(g) for g in self.groups]
        self.model = models[0] if models else self.spark.createDataFrame([], MODEL)
        for m in models[1:]:
            self.model = self.model.unionByName(m)

    def _moments(self, dims: list[int]) -> dict[int, tuple[int, list[int]]]:
        out: dict[int, tuple[int, list[int]]] = {}
        for r in self.sums.where(F.col("dim").isin(dims)).orderBy("dim", "i").collect():
            out.setdefault(r.dim, (int(r.n), []))[1].append(int(r.s))
        return out

    def _fitted(self, dims: list[int]) -> DataFrame:
        moments, k = self._moments(dims), self.k
        means = {dim: np.array([_ratio(v, n) for v in s]) for dim, (n, s) in moments.items()}
        parts = self.fit.where(F.size("x").isin(dims)).mapInArrow(_products(means), "dim int, i int, row array<double>")
        rows = parts.groupBy("dim", "i").applyInArrow(_added, "dim int, i int, row array<double>")

        def solved_(t: pa.Table) -> pa.Table:
            dim = t.column("dim")[0].as_py()
            order = np.argsort(t.column("i").to_numpy())
            v = np.asarray(t.column("row").combine_chunks().flatten(), np.float64).reshape(dim, dim)[order] / moments[dim][0]
            values, out = eigen((v + v.T) / 2, k)
            keep = values > LEAST * max(values.max(initial=0.0), 0.0)
            one = {"dim": dim, "n": moments[dim][0], "mean": means[dim], "trace": float(np.trace(v)), "value": values[keep], "component": list(out[keep])}
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64())))
            return pa.table({c: pa.array([v], t) for (c, v), t in zip(one.items(), kinds)})

        found = rows.groupBy("dim").applyInArrow(solved_, MODEL.replace("sums array<decimal(38,0)>, ", ""))
        sums = self.sums.where(F.col("dim").isin(dims)).groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("sums"))
        return cut_lineage(found.join(sums.select("dim", F.col("sums.s").alias("sums")), "dim").select("dim", "n", "mean", "sums", "trace", "value", "component"))

    def _held(self, dims: list[int]):
        """The model of some lengths, as a broadcast variable."""
        rows = self.model.where(F.col("dim").isin(dims)).collect()
        return self.spark.sparkContext.broadcast({r.dim: _Projection(r) for r in rows})

    def identity_error(self) -> DataFrame:
        """``dim, identity_error``: the largest entry, in size, of the whitened fit list's covariance minus the identity."""
        schema = "dim int, n long, i int, sums double, row array<double>"

        def run(held):
            def moments(batches):
                total: dict[int, list] = {}
                for _, x in _matrices(batches):
                    if (p := held.value.get(x.shape[1])) is None or not len(p.value):
                        continue
                    w = p.whitened(x)
                    t = total.setdefault(x.shape[1], [0, 0.0, 0.0])
                    t[:] = t[0] + len(w), t[1] + w.sum(axis=0), t[2] + w.T @ w
                for dim, (n, s, m) in total.items():
                    cols = [[dim] * len(s), [n] * len(s), list(range(len(s))), s, list(m)]
                    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["dim", "n", "i", "sums", "row"])

            return moments

        parts = [self.fit.where(F.size("x").isin(g)).mapInArrow(run(self._held(g)), schema) for g in self.groups]
        if not parts:
            return self.spark.createDataFrame([], "dim int, identity_error double")
        cells = None
        for p in parts:
            cells = p if cells is None else cells.unionByName(p)
        cells = cells.select("dim", "n", "i", "sums", F.posexplode("row").alias("j", "v"))
        cells = cells.groupBy("dim", "i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("sums").alias("s"))
        # the whitened values are centred already; what is left of their means is taken off all the same
        means = cells.where("j = 0").select("dim", F.col("i").alias("j"), (F.col("s") / F.col("n")).alias("mean_j"))
        cells = cells.join(means, ["dim", "j"]).withColumn("c", F.col("v") / F.col("n") - F.col("s") / F.col("n") * F.col("mean_j"))
        return cells.groupBy("dim").agg(F.max(F.abs(F.col("c") - (F.col("i") == F.col("j")).cast("double"))).alias("identity_error"))

    def project(self, rows: DataFrame, key: str, vector: str = "x") -> DataFrame:
        """``key, component, n, deviation, whitened, explained`` and ``dim`` for each row and component."""
        rows = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("x")).where("x is not null")
        kind = rows.schema["key"].dataType.simpleString()
        schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, dim int"

        def run(held):
            def out(batches):
                for (keys,), x in _matrices(batches, 1):
                    if (p := held.value.get(x.shape[1])) is None or not len(p.value):
                        continue
                    for at in range(0, len(x), 4096):
                        part, ids = x[at : at + 4096], keys[at : at + 4096]
                        k = len(p.value)
                        of = np.repeat(np.arange(len(part)), k)
                        cols = [
                            ids.take(pa.array(of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(len(of), p.n)),
                            p.deviation(part).take(pa.array(of)), pa.array(p.whitened(part).ravel()), pa.array(np.tile(p.value / p.trace, len(part))),
                            pa.array(np.full(len(of), x.shape[1], np.int32)),
                        ]
                        yield pa.RecordBatch.from_arrays(cols, [key, "component", "n", "deviation", "whitened", "explained", "dim"])

            return out

        found = None
        for g in self.groups:
            part = rows.where(F.size("x").isin(g)).mapInArrow(run(self._held(g)), schema)
            found = part if found is None else found.unionByName(part)
        return found if found is not None else self.spark.createDataFrame([], schema)


class _Projection:
    """The model of one vector length."""

    def __init__(self, row):
        self.n, self.trace, self.mean = row.n, row.trace, np.array(row["mean"])
        self.sums, self.value = [int(s) for s in row.sums], np.array(row["value"])
        self.component = np.array(row.component).reshape(len(self.value), len(self.mean))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.component.T / np.sqrt(self.value)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of ``(n x - S)^2``, exactly; null beyond a long."""
        bound = max([self.n * int(np.abs(x).max(initial=0)), *map(abs, self.sums)])
        if 4 * bound < 2**63:
            d = self.n * x - np.array(self.sums, np.int64)
            if x.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < 2**63:
                return pa.array((d * d).sum(axis=1), pa.int64())
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(r, self.sums)) for r in x.tolist()]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def _ratio(a: int, b: int) -> float:
    """``a / b`` to the nearest double."""
    return a / b


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings: ``vec_id, component, n, deviation, whitened, explained, identity_error`` (the greatest of all
    vector lengths) for up to 16 components."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding"), 64, 1_000_000).alias("x"))
    model = Whitening(rows, k=16)
    error = model.identity_error().agg(F.max("identity_error")).first()[0]
    return model.project(rows, "vec_id").drop("dim").withColumn("identity_error", F.lit(error).cast("double"))
