import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seclog.llm import negatives
from seclog.llm.negatives import Blocks, bounds, hilbert_keys, mine, search, whole
from seclog.llm.queries import queries


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    """``rows``: distinct (id, label, tuple of whole numbers)."""
    out = []
    for a_id, a_label, a in rows:
        if not is_anchor(a_id):
            continue
        scored = sorted((-sum(p * q for p, q in zip(a, x)), i, label) for i, label, x in rows if i != a_id and len(x) == len(a))
        for p, p_id, _ in [s for s in scored if s[2] == a_label][:positives]:
            fine = [s for s in scored if s[2] != a_label and low * -p <= 100 * -s[0] <= high * -p]
            out += [(a_id, p_id, k + 1, n_id, -p, -n) for k, (n, n_id, _) in enumerate(fine[:negatives])]
    return sorted(out)


def rows_of(df, scale=256, relabel=True):
    out = set()
    for r in df.collect():
        if r.vec_id is None or r.label is None or not r.embedding or not all(c is not None and math.isfinite(c) for c in r.embedding):
            continue
        label = (r.label + 1) % 10 if relabel and r.vec_id % 7 == 0 else r.label
        out.add((r.vec_id, label, tuple(math.floor(scale * c) for c in r.embedding)))
    return sorted(out)


COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_the_curve_goes_in_single_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = np.arange(1 << bits)
        points = np.stack(np.meshgrid(*[side] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = [k.tobytes() for k in hilbert_keys(points, bits)]
        assert len(set(keys)) == len(points)
        path = points[sorted(range(len(points)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for size in (100, 2**28):
        x, a = rng.integers(-size, size, (50, 64)), rng.integers(-size, size, (20, 64))
        least, most = bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
        exact = [[sum(int(p) * int(q) for p, q in zip(u, v)) for v in x] for u in a]
        assert all(least[i, 0] <= min(row) and max(row) <= most[i, 0] for i, row in enumerate(exact))


def clustered(n, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dims))
    x = centre[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, dims))
    return [(i, int(rng.integers(0, 4)), [float(c) for c in v]) for i, v in enumerate(x)]


def test_against_brute_force_in_small_blocks(spark, monkeypatch):
    """Many blocks, segments, zone packs and salts; integer ties; a label that holds half of the rows."""
    monkeypatch.setattr(negatives, "ZONES", 8)
    monkeypatch.setattr(negatives, "PACK_ANCHORS", 5)
    monkeypatch.setattr(negatives, "SALT_PACKS", 2)
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 3)) * int(rng.integers(0, 2)), [float(c) for c in rng.integers(-2, 4, 6)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    blocks = Blocks(df.select("vec_id", "label", whole(F.col("embedding"), 1).alias("x")), block_rows=7)
    got = sorted(tuple(r) for r in mine(blocks, blocks.ordered.where("vec_id % 20 = 0")).select(*COLS).collect())
    assert got and got == brute(rows_of(df, 1, False), lambda i: i % 20 == 0)


def test_blocks_out_of_reach_are_not_read(spark):
    rows = clustered(4000)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    blocks = Blocks(df.select("vec_id", "label", whole(F.col("embedding"), 256).alias("x")), block_rows=32)
    anchors = blocks.ordered.where("vec_id % 100 = 0").withColumns({"lo": F.array(F.lit(negatives.LEAST + 1)), "hi": F.array(F.lit(negatives.MOST))})
    packs = negatives._packed(blocks, anchors, 40).withColumn("floors", F.col("lo")).collect()
    zones = blocks.zones.collect()
    total = sum(negatives.chosen({**p.asDict(), **z.asDict()}, True, True).sum() for p in packs for z in zones)
    assert total == 40  # one block for each anchor at first
    read = []
    run = negatives._read

    def counted(k, same):
        return run(k, same)

    found = search(blocks, anchors, 5, same=True).collect()
    exact = {}
    by = rows_of(df, 256, False)
    for i, label, x in by:
        if i % 100 == 0:
            exact[i] = [s[1] for s in sorted((-sum(p * q for p, q in zip(x, y)), j) for j, other, y in by if other == label and j != i)[:5]]
    ids = {r.row: r.vec_id for r in blocks.ordered.collect()}
    mine_ = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        mine_.setdefault(ids[r.row], []).append(r.vec_id)
    assert mine_ == exact
    # with the floors known, most blocks are out of reach
    floors = {r.row: r.score for r in found if r["rank"] == 5}
    picked = pairs = 0
    for p in packs:
        r = p.asDict()
        order = np.frombuffer(r["rows"], np.int64).tolist()
        r["floors"] = np.array([floors[o] for o in order], np.int64).tobytes()
        for z in zones:
            picked += negatives.chosen({**r, **z.asDict()}, True, False).sum()
            pairs += len(order) * len(np.frombuffer(z["blocks"], np.int64))
    assert picked < 0.25 * pairs


def test_odd_rows(spark):
    rows = [(i, i % 3, [float(i % 5), 1.0, -float(i % 7)]) for i in range(0, 160)] + [(0, 0, [0.0, 1.0, -0.0])] * 3
    rows += [(None, 1, [1.0, 2.0, 3.0]), (200, None, [1.0, 2.0, 3.0]), (250, 1, None), (300, 1, []), (350, 1, [1.0, None, 2.0]), (400, 1, [float("nan")] * 3), (450, 1, [float("inf"), 1.0, 1.0])]
    rows += [(500, 1, [1.0, 2.0]), (501, 1, [2.0, 2.0]), (502, 2, [1.0, 1.0]), (550, 1, [9.0]), (50, 2, [3.0, 3.0, 3.0]), (600, -1, [1e300, 1.0, 1.0]), (601, -1, [1e300, 2.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, block string")
    blocks = Blocks(df.select("vec_id", "label", whole(F.col("embedding"), 256).alias("x"), "block"))
    got = sorted(tuple(r) for r in mine(blocks, blocks.ordered.where("vec_id % 50 = 0")).select(*COLS).collect())
    limit = int((2.0**62 / 3) ** 0.5)
    clipped = [(i, label, tuple(max(-limit, min(limit, c)) for c in x)) for i, label, x in rows_of(df, 256, False)]
    assert got == brute(clipped, lambda i: i % 50 == 0)


@pytest.mark.parametrize("sf_", ["sf0.001", "sf0.01"])
def test_query(spark, sf_):
    d = f"/root/testdata/{sf_}"
    rows = rows_of(spark.read.parquet(f"{d}/embeddings.parquet"))
    out = queries()["op11_hard_negatives"](spark, d)
    assert [f.dataType.simpleString() for f in out.select(*COLS).schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert sorted(tuple(r) for r in out.select(*COLS).collect()) == brute(rows, lambda i: i % 50 == 0)
