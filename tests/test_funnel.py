"""Clustering, verdict ladder, keyword hits and roll-up properties."""

import hashlib

from pyspark.sql import functions as F

import golden
from seclog.functions.text import clean_domain, keyword_hits
from seclog.operators.funnel import cluster_events, cluster_ids, cluster_key, filter_chunks, merged_iocs, suspicious
from seclog.operators.verdicts import parse_verdicts
from seclog.plans import inputs
from seclog.plans.queries import queries

def test_verdict_ladder(spark):
    df = spark.createDataFrame([(i, v[0]) for i, v in enumerate(golden.VERDICTS)], "id long, raw string")
    for r in parse_verdicts(df, keep=["id"]).collect():
        text, threat, error = golden.VERDICTS[r.id]
        assert (r.is_threat, r.error) == (threat, error), text


def test_cluster_ids(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(golden.CLUSTERS)], "chunk_ix int, chunk string")
    for r in cluster_key(suspicious(filter_chunks(df, decode="none"))).collect():
        _, ip, sig = golden.CLUSTERS[r.chunk_ix]
        assert (r.src_ip, r.signature, r.cluster_id) == (ip, sig, hashlib.md5(f"{ip}:{sig}".encode()).hexdigest()[:12])


def test_sample_counts_add_up(spark, sf):
    lines = inputs.seclog_chunks(spark, sf)
    keyed = cluster_key(suspicious(filter_chunks(lines, decode="none")))
    total = cluster_events(keyed).agg(F.sum("sample_count")).first()[0]
    assert total == keyed.count()


def test_merged_iocs_are_distinct(spark, sf):
    keyed = cluster_key(suspicious(filter_chunks(inputs.seclog_chunks(spark, sf), decode="none")))
    m = merged_iocs(keyed)
    assert m.count() == m.select("log_id", "cluster_id", "type", "value").distinct().count()


def test_keyword_hits(spark):
    want = {"UNION SELECT * from x <SCRIPT>": ["union select", "<script>"], "cmd.exe ../../etc Mimikatz": ["cmd.exe", "../..", "mimikatz"], "clean": []}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.k for r in df.select("t", keyword_hits(F.col("t")).alias("k")).collect()} == want


def test_clean_domain(spark):
    cases = {" HTTPS://Evil.com:443/x ": "evil.com", "ftp://a.b/c": "a.b", "https://http://x.io": "x.io", "plain.org": "plain.org"}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    got = [r.c for r in df.select(clean_domain(F.col("d")).alias("c")).collect()]
    assert got == list(cases.values())


def test_run_summary_covers_every_log(spark, sf):
    runs = queries()["run_summary"](spark, sf)
    users = inputs.seclog_lines(spark, sf).select("user_id").distinct().count()
    assert runs.count() == users
    assert runs.where(F.col("suspicious_chunks") > F.col("total_chunks_processed")).count() == 0


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() >= 0
    assert "summary" in df.columns


def test_cluster_ids_without_indicators_agree(spark, sf):
    """The counting form gives each chunk the cluster of the full form, or null."""
    lines = inputs.seclog_chunks(spark, sf).select("log_id", "chunk_ix", "chunk")
    odd = ["google.com", "google.com and GOOGLE.com.", "a.com-x", "x " * 10, "", " \n", "User-Agent: short", "User-Agent: long enough", "1.2.3.4.5", "example.com evil.com"]
    odd = spark.createDataFrame([(0, i, t) for i, t in enumerate(odd)], lines.schema)
    for df in (lines, odd):
        full = filter_chunks(df, decode="reference")
        want = {(r.log_id, r.chunk_ix): r.cluster_id if r.is_suspicious else None for r in cluster_key(full).collect()}
        got = {(r.log_id, r.chunk_ix): r.cluster_id for r in cluster_ids(df, keys=("log_id", "chunk_ix"), decode="reference").collect()}
        assert got == want


def test_texts_are_not_aggregated(spark, sf):
    """Clusters, merged indicators and the knowledge base are found by hash aggregates; texts are joined afterwards."""
    for name in ("cluster_events", "merged_iocs", "ioc_summary", "funnel_documents", "funnel_documents_decoded", "kb_upsert", "kb_delete", "kb_files"):
        plan = queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan, name


def test_merged_places_beyond_int(spark):
    """Chunk numbers of any size, also where an indicator comes in several chunks of a cluster."""
    big = 2**40
    rows = [(1, big + 5, "1.1.1.1 evil.com"), (1, big + 3, "1.1.1.1 a.io evil.com"), (1, big + 9, "1.1.1.1 EVIL.com")]
    for kind in ("long", "int"):
        base = big if kind == "int" else 0
        df = spark.createDataFrame([(a, b - base, c) for a, b, c in rows], f"log_id int, chunk_ix {kind}, chunk string")
        keyed = cluster_key(suspicious(filter_chunks(df, decode="none")))
        got = sorted((r.type, r.value, r.first_chunk_ix + base, r.first_ioc_ix, r.context) for r in merged_iocs(keyed).collect())
        first = "1.1.1.1 a.io evil.com"
        assert got == [("domain", "EVIL.com", big + 9, 1, "1.1.1.1 EVIL.com"), ("domain", "a.io", big + 3, 1, first), ("domain", "evil.com", big + 3, 2, first), ("ipv4", "1.1.1.1", big + 3, 0, first)]
        assert merged_iocs(keyed).schema["first_chunk_ix"].dataType.simpleString() == {"long": "bigint", "int": "int"}[kind]
