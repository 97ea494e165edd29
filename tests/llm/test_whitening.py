import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seclog.llm.queries import queries
from seclog.llm.whitening import Whitening, below, eigen, leading, quantised, tridiagonal, vectors


def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * values) @ q.T


CASES = {
    "spread": spectrum(np.linspace(1, 50, 40)),
    "clusters": spectrum(np.r_[np.full(5, 9.0), np.full(7, 9.0 + 1e-12), np.linspace(0.1, 8, 20)]),
    "equal": np.eye(20) * 3.0,
    "diagonal": np.diag(np.r_[5.0, 5.0, 5.0, 4.0, np.zeros(10)]),
    "steep": spectrum(10.0 ** -np.arange(0, 9)),
    "low rank": spectrum(np.r_[np.zeros(20), 1.0, 2.0, 2.0]),
    "two": np.array([[2.0, 1.0], [1.0, 2.0]]),
    "one": np.array([[7.0]]),
    "big": spectrum(np.random.default_rng(1).random(64)) * 1e12,
}


@pytest.mark.parametrize("name", CASES)
def test_eigen(name):
    a = CASES[name]
    a = (a + a.T) / 2
    values, out = eigen(a, 16)
    k, size = min(16, len(a)), np.abs(a).max()
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-13 * len(a) * size, rtol=0)
    assert np.allclose(out @ out.T, np.eye(k), atol=1e-12)
    assert np.abs(a @ out.T - out.T * values).max() <= 1e-12 * len(a) * size


def test_tridiagonal_and_sturm_counts():
    a = CASES["spread"]
    d, e, _ = tridiagonal((a + a.T) / 2)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    true = np.linalg.eigvalsh(t)
    assert np.allclose(true, np.linspace(1, 50, 40))
    x = np.linspace(0, 51, 300)
    assert (below(d, e, x, 1e-300) == (true[None, :] < x[:, None]).sum(axis=1)).all()
    assert np.allclose(leading(d, e, 7), true[::-1][:7], atol=1e-12)
    v = vectors(d, e, leading(d, e, 7))
    assert np.abs(t @ v.T - v.T * true[::-1][:7]).max() < 1e-12


def check(spark, df, scale, offset, k=16):
    """The operator against whole numbers and numpy's own eigenvectors."""
    rows = df.select("vec_id", quantised(F.col("embedding"), scale, offset).alias("x"))
    model = Whitening(rows, k=k)
    got = model.project(rows, "vec_id").collect()
    errors = {r.dim: r.identity_error for r in model.identity_error().collect()}
    want = {}
    for r in df.collect():
        if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding) and r.embedding:
            want.setdefault(len(r.embedding), []).append((r.vec_id, tuple(math.floor(scale * c) + offset for c in r.embedding)))
    seen = 0
    for dim, rows_ in want.items():
        fit = sorted({x for _, x in rows_})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        centred = np.array([[(n * c - t) / n for c, t in zip(x, s)] for x in fit])
        v = centred.T @ centred / n
        values = np.linalg.eigvalsh(v)[::-1][:k]
        values = values[values > 1e-11 * max(values[0], 0)]
        mine = [r for r in got if r.dim == dim]
        assert len(mine) == len(rows_) * len(values)
        seen += len(mine)
        by = {}
        for r in mine:
            assert r.n == n and abs(r.explained - values[r.component - 1] / np.trace(v)) <= 1e-6 * r.explained
            by.setdefault((r.vec_id, r.deviation), {})[r.component] = r.whitened
        dev = {(i, sum((n * c - t) ** 2 for c, t in zip(x, s))): x for i, x in rows_}
        assert set(by) == (set(dev) if len(values) else set())
        if not by:
            continue
        white = np.array([[by[key][c] for c in range(1, len(values) + 1)] for key in {x: k for k, x in dev.items()}.values()])
        if len(values):
            assert np.abs(white.T @ white / n - np.eye(len(values))).max() < 1e-6 and errors[dim] < 1e-6
            # x is recovered from all components of a full spectrum; else distances along them agree
            w, vec = np.linalg.eigh(v)
            vec = vec[:, ::-1][:, : len(values)]
            x = np.array([[(n * c - t) / n for c, t in zip(dev[key], s)] for key in {x: k for k, x in dev.items()}.values()])
            theirs = x @ vec / np.sqrt(values)
            assert np.allclose((white**2).sum(axis=1), (theirs**2).sum(axis=1), rtol=1e-6, atol=1e-6) or len(values) == k
    assert seen == len(got)


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 24)) @ rng.standard_normal((24, 24)) * 0.2
    x = np.concatenate([x, np.repeat(x[:3], 300, axis=0)])  # a hot vector counts once
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    check(spark, df, 64, 1_000_000)
    check(spark, df, 64, 2**40, k=3)  # far from zero


def test_low_rank_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    low = rng.integers(-3, 4, (50, 2)) @ rng.integers(-2, 3, (2, 6))
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(low)]
    rows += [(100, None), (101, []), (102, [1.0, None]), (103, [float("nan")] * 6), (104, [float("inf")] * 6), (None, [1.0] * 6), (0, rows[0][1]), (0, rows[0][1])]
    rows += [(200 + i, [float(i), 1.0, -float(i * i)]) for i in range(5)] + [(300, [4.0]), (301, [4.0])]
    check(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1, 7)


def test_groups_of_lengths_and_large_entries(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11) for j in range(1 + i % 4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", quantised(F.col("embedding"), 64, 0).alias("x"))
    whole, split = Whitening(df, k=4), Whitening(df, k=4, limit=1)
    assert len(whole.groups) == 1 and len(split.groups) == 4
    cols = ["vec_id", "component", "n", "deviation", "dim"]
    assert sorted(whole.project(df, "vec_id").select(*cols).collect()) == sorted(split.project(df, "vec_id").select(*cols).collect())
    big = spark.createDataFrame([(1, [1e300, 2.0]), (2, [-1e300, 2.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    big = big.select("vec_id", quantised(F.col("embedding"), 64, 1_000_000).alias("x"))
    out = Whitening(big).project(big, "vec_id").collect()
    assert {r.vec_id: r.deviation for r in out}[3] is not None and {r.vec_id: r.deviation for r in out}[1] is None


def test_query(spark, sf):
    rows = queries()["op12_whitening"](spark, sf).toPandas()
    vecs = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(vecs.embedding.to_numpy()).astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    values, comps = np.linalg.eigh(c.T @ c / n)
    values, comps = values[::-1][:16], comps[:, ::-1][:, :16]
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").loc[vecs.vec_id].to_numpy()
    want = (x - s / n) @ comps / np.sqrt(values)
    assert np.abs(np.abs(wide) - np.abs(want)).max() < 1e-8
    dev = dict(zip(vecs.vec_id, ((n * x - s) ** 2).sum(axis=1)))
    assert (rows.deviation == rows.vec_id.map(dev)).all() and (rows.n == n).all() and rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-10
    assert len(rows) == 16 * len(vecs)
