"""Knowledge base: exact top-k against brute force, upsert semantics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seclog.operators import kb
from seclog.plans import inputs


def test_topk_matches_brute_force(spark, sf):
    e = inputs.embedding_kb(spark, sf)
    q = e.select(F.col("id").alias("query_id"), "file_id", F.col("embedding").alias("vector"))
    got = {}
    for r in kb.kb_topk(q, e, k=4, block_rows=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    rows = e.collect()
    by_label = {}
    for r in rows:
        by_label.setdefault(r.file_id, []).append(r)
    for lab, rs in by_label.items():
        m = np.array([r.embedding for r in rs], dtype=np.float64)
        n = np.linalg.norm(m, axis=1)
        d = np.round(1 - (m @ m.T) / np.outer(n, n), 6)
        ids = [r.id for r in rs]
        for i, r in enumerate(rs):
            order = sorted(range(len(rs)), key=lambda j: (d[i, j], ids[j]))[:4]
            assert [ids[j] for j in order] == [x for _, x in sorted(got[r.id])]


def test_upsert_last_write_wins(spark):
    cols = "id string, content string, embedding array<float>, file_id string, chunk_index int, content_hash string, source string"
    existing = spark.createDataFrame([("f_chunk_0", "old0", None, "f", 0, "h0", "a"), ("f_chunk_1", "old1", None, "f", 1, "h0", "a")], cols)
    new = spark.createDataFrame(
        [("f_chunk_0", "n0", None, "f", 0, "h1", "b", 1), ("f_chunk_0", "m0", None, "f", 0, "h2", "c", 2)],
        cols + ", file_order long",
    )
    out = {r.id: r.content for r in kb.kb_upsert(existing, new).collect()}
    assert out == {"f_chunk_0": "m0", "f_chunk_1": "old1"}
    out2 = {r.id: r.content for r in kb.kb_upsert(existing, new, replace=True).collect()}
    assert out2 == {"f_chunk_0": "m0"}


def test_kb_versioned_write_and_pruned_read(spark, sf, tmp_path):
    from seclog.plans.analyze import index_kb

    files = inputs.kb_document_files(spark, sf)
    table, report = index_kb(files)
    path = kb.write_kb(table, str(tmp_path))
    one = kb.read_kb(spark, path, file_id="doc1", with_embedding=False)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(file_id,doc1)" in plan and "embedding" not in plan
    assert len(one.inputFiles()) < len(kb.read_kb(spark, path).inputFiles())
    assert one.count() == table.where(F.col("file_id") == "doc1").count()
    assert report.where(F.col("status") == "success").count() == kb.kb_new_docs(files).count()


def chunks(spark, rows):
    """(file, index, text, order)."""
    full = [(f"{f}_chunk_{i}", t, None, f, i, "h", "s", o) for f, i, t, o in rows]
    return spark.createDataFrame(full, kb.KB_SCHEMA + ", file_order long")


def test_store_rewrites_only_touched_buckets(spark, tmp_path):
    store = kb.KbStore(spark, str(tmp_path / "kb"))
    assert store.current() == 0 and store.read().count() == 0
    assert store.upsert(chunks(spark, [(f"f{i}", 0, f"old{i}", 1) for i in range(40)])) == 1
    before, files = store.buckets(), set(store.read(1).inputFiles())
    assert store.upsert(chunks(spark, [("f3", 0, "new3", 2), ("f3", 1, "more3", 2)])) == 2
    after = store.buckets()
    changed = {b for b in after if after[b] != before.get(b)}
    assert len(changed) == 1
    # the files of the other buckets are the same
    assert set(store.read(2).inputFiles()) & files == {f for f in files if not any(f"bucket={b}/" in f for b in changed)}
    assert {r.id: r.content for r in store.read(file_id="f3").collect()} == {"f3_chunk_0": "new3", "f3_chunk_1": "more3"}
    assert store.read(1, file_id="f3").first().content == "old3"  # the version before is still there
    assert store.delete(spark.createDataFrame([("f3",), ("nobody",)], "file_id string")) == 3
    assert store.read(file_id="f3").count() == 0 and store.read().count() == 39
    assert store.delete(spark.createDataFrame([("nobody",)], "file_id string")) in (3, 4)
    assert store.upsert(chunks(spark, [])) == store.current()
    rows = sorted(r.id for r in store.read().collect())
    store.vacuum(keep=1)
    assert len(store.versions()) == 1 and sorted(r.id for r in store.read().collect()) == rows


def test_a_failed_or_late_write_leaves_the_old_version(spark, tmp_path):
    store = kb.KbStore(spark, str(tmp_path / "kb"))
    store.upsert(chunks(spark, [("a", 0, "x", 1)]))

    @F.udf("string")
    def broken(_):
        raise ValueError("no")

    with pytest.raises(Exception):
        store.upsert(chunks(spark, [("a", 0, "y", 2)]).withColumn("content", broken("content")))
    assert store.current() == 1 and store.read().first().content == "x"
    # two writers start from version 1: the second one to publish is refused
    rows = chunks(spark, [("b", 0, "z", 2)]).drop("file_order")
    touched = store._touched(rows)
    assert store._write(rows, 1, touched) == 2
    with pytest.raises(kb.KbConflict):
        store._write(rows, 1, touched)
    assert store.current() == 2 and sorted(r.content for r in store.read().collect()) == ["x", "z"]


def test_lsh_topk_recall(spark):
    """On the given vectors, and on clustered ones in files of different sizes, where few pairs are compared."""
    from seclog.plans.queries import queries

    d = "/root/testdata/sf0.1"
    pairs = lambda df: {(r.query_id, r.file_id, r.id, r.distance) for r in df.collect()}
    exact, found = pairs(queries()["kb_topk"](spark, d)), pairs(queries()["kb_topk_lsh"](spark, d))
    assert len({(q, f, i) for q, f, i, _ in exact & found}) >= 0.9 * len(exact)

    rng = np.random.default_rng(3)
    centre = rng.normal(size=(60, 32))
    rows = [(i, f"f{i % 3}" if i % 3 else "f0", [float(c) for c in centre[rng.integers(60)] + 0.15 * rng.normal(size=32)]) for i in range(3000)]
    rows += [(3000 + i, "f0", rows[0][2]) for i in range(300)]  # a hot bucket
    e = spark.createDataFrame(rows, "id long, file_id string, embedding array<float>")
    q = e.where("id % 10 = 0").select(F.col("id").alias("query_id"), "file_id", F.col("embedding").alias("vector"))
    exact = {(r.query_id, r.id) for r in kb.kb_topk(q, e, k=5).collect()}
    got = kb.kb_topk_lsh(q, e, dims=32, k=5, tables=8, bits=8, block_rows=100).collect()
    assert len({(r.query_id, r.id) for r in got} & exact) >= 0.9 * len(exact)
    assert max(r["rank"] for r in got) == 5
    codes = e.select(F.explode(kb.hyperplane_codes(F.col("embedding"), 32, 8, 8)).alias("c"), "file_id").groupBy("c", "file_id").count()
    compared = codes.agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert compared < 0.5 * (1300**2 + 1000**2 + 1000**2) * 8 / 8


def test_embedding_in_batches(spark):
    sizes = spark.createDataFrame([(i, None if i == 7 else "x" * i) for i in range(50)], "i int, content string").coalesce(1)

    def make():
        return lambda texts: [[float(len(t)), float(len(texts))] for t in texts]

    out = {r.i: r.v for r in sizes.select("i", kb.embed_in_batches(make, 20)(F.col("content")).alias("v")).collect()}
    assert out[7] is None and out[8][0] == 8 and max(v[1] for v in out.values() if v) == 20


def test_result_sink_writes_json(spark, sf, tmp_path):
    from seclog.plans import inputs
    from seclog.plans.analyze import analyze_logs
    from seclog.sources.logs import write_result

    a = analyze_logs(inputs.text_logs(spark, sf), decode="none")
    write_result(a.runs, str(tmp_path), a.clusters)
    back = spark.read.json(f"{tmp_path}/runs")
    assert back.count() == inputs.text_logs(spark, sf).count()
