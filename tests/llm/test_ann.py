import numpy as np

from seclog.llm.ann import build, index, search
from seclog.llm.queries import queries


def exact(ids, x, q_id, q, k=10):
    score = np.sqrt(((x - q) ** 2).sum(axis=1))
    return sorted((s, i) for s, i in zip(score.tolist(), ids.tolist()) if i != q_id)[:k]


def test_recall_and_exact_scores(spark):
    """Two thousand clustered and three thousand scattered vectors in several shards."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(20, 32)).repeat(100, axis=0) * 3 + rng.normal(size=(2000, 32)), rng.normal(size=(3000, 32))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<float>")
    out = search(index(df, shard_rows=1500), df.where("vec_id % 100 = 0"), query_rows=20).collect()
    x, ids, hits = x.astype(np.float64), np.arange(len(x)), []
    for q in range(0, len(x), 100):
        mine = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        want = exact(ids, x, q, x[q])
        assert [r.rank for r in mine] == list(range(1, 11))
        assert all(abs(r.score - np.sqrt(((x[r.vec_id] - x[q]) ** 2).sum())) < 1e-12 for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hits.append(len({r.vec_id for r in mine} & {i for _, i in want}) / 10)
    assert np.mean(hits) >= 0.95


def test_query_recall(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    got = {}
    for r in queries()["op3_ann"](spark, d).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    assert np.mean([len(got[q] & {i for _, i in exact(ids, x, q, v)}) / 10 for q, v in zip(ids.tolist(), x) if q % 100 == 0]) >= 0.95


def test_small_graphs():
    for m in (1, 2, 5, 40):
        x = np.arange(m * 2, dtype=np.float32).reshape(m, 2)
        g = build(x)
        found, _ = g.search(x, 8)
        assert (found[:, 0] == np.arange(m)).all()
        assert ((g.to >= -1) & (g.to < m)).all() and (g.to != np.arange(m)[:, None]).all()
