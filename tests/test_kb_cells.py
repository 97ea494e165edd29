"""Top-k by cells: exact, and without comparing all pairs."""

import numpy as np
from pyspark.sql import functions as F

from seclog.operators import kb


def _brute(q, e, k):
    out = []
    for qid, qf, qv in q:
        if qv is None:
            continue
        with np.errstate(all="ignore"):
            d = [(np.round(1 - np.dot(qv, v) / (np.linalg.norm(qv) * np.linalg.norm(v)), 6), i) for i, f, v in e if f == qf and v is not None]
        out += [(qid, r, i) for r, (_, i) in enumerate(sorted(d, key=lambda x: (np.isnan(x[0]), 0 if np.isnan(x[0]) else x[0], x[1]))[:k], 1)]
    return sorted(out)


def _rows(seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 12, (3000, 5)).astype(float)
    v[:400] = v[7]  # one large group of equal vectors
    v[400:420] = 0
    v[420] = np.nan
    e = [(f"c{i:05d}", "a" if i % 5 else "b", v[i].tolist()) for i in range(3000)] + [("d1", "tiny", [1.0] * 5), ("d3", "tiny", None)]
    q = [(i, "a", v[i * 7].tolist()) for i in range(400)] + [(1000 + i, "b", v[i * 11].tolist()) for i in range(50)]
    return e, [*q, (2000, "tiny", [1.0, 2.0, 0.0, 0.0, 1.0]), (2001, "a", [0.0] * 5), (2002, "b", None), (2003, "gone", [1.0] * 5)]


def test_cells_find_what_brute_force_finds(spark):
    e, q = _rows(3)
    kdf = spark.createDataFrame(e, "id string, file_id string, embedding array<double>")
    qdf = spark.createDataFrame(q, "query_id long, file_id string, vector array<double>")
    for k, cell_rows in ((3, 150),):
        got = sorted((r.query_id, r.rank, r.id) for r in kb.kb_topk(qdf, kdf, k=k, block_rows=64, cell_rows=cell_rows).collect())
        assert got == _brute(q, e, k)


def test_compared_pairs_grow_with_the_input_not_its_square(spark, monkeypatch):
    """Four times the chunks and queries: far less than sixteen times the pairs."""
    blocks, pairs = kb._block_hits, []

    def counted(queries, chunks, on, k, block_rows):
        n = queries.groupBy(*on).agg(F.count("*").alias("a")).join(chunks.groupBy(*on).agg(F.count("*").alias("b")), on)
        pairs[-1] += n.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
        return blocks(queries, chunks, on, k, block_rows)

    monkeypatch.setattr(kb, "_block_hits", counted)
    for n in (1500, 6000):
        rng = np.random.default_rng(n)
        v = rng.standard_normal((n, 4)).round(3)
        kdf = spark.createDataFrame([(i, "f", x.tolist()) for i, x in enumerate(v)], "id long, file_id string, embedding array<double>")
        qdf = kdf.where("id % 10 = 0").select(F.col("id").alias("query_id"), "file_id", F.col("embedding").alias("vector"))
        pairs.append(0)
        kb.kb_topk(qdf, kdf, k=3, cell_rows=25)
        assert pairs[-1] < n * n / 10 / 4
    assert pairs[1] < 8 * pairs[0]
