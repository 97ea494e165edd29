"""File intake (charset ladder, admission) and the streaming jobs."""

import os
import tempfile

from pyspark.sql import functions as F

from seclog.operators.funnel import cluster_key, cluster_windows, filter_chunks, suspicious
from seclog.plans import inputs
from seclog.plans.analyze import analyze_logs, extract_iocs_files
from seclog.sources.logs import admit_logs, list_files, logs_from_files, read_logs, read_responses, write_snapshot
from seclog.streaming.intake import stream_cluster_windows, stream_logs, stream_worklist


def _write(d, name, data: bytes):
    with open(os.path.join(d, name), "wb") as f:
        f.write(data)


def test_charset_ladder_and_admission(spark):
    d = tempfile.mkdtemp(prefix="seclog-intake-")
    samples = {
        "empty.log": b"",
        "a.log": "src 10.0.0.1 cmd.exe ✓".encode("utf-8"),
        "b.txt": "攻击 来自 10.0.0.2".encode("gbk"),
        "c.json": b"caf\xe9 \xff\xfe 10.0.0.3",
        "d.bin": b"ignored by extension",
        "big.log": b"x" * (2 * 1024 * 1024 + 1),
    }
    for k, v in samples.items():
        _write(d, k, v)
    files = read_logs(spark, d)
    accepted, rejected = admit_logs(files, max_mb=2)
    texts = {os.path.basename(r.log_id): r.text for r in logs_from_files(accepted).collect()}
    assert texts == {
        "empty.log": "",
        "a.log": samples["a.log"].decode("utf-8"),
        "b.txt": samples["b.txt"].decode("gbk"),
        "c.json": samples["c.json"].decode("latin-1"),
    }
    counts, over = extract_iocs_files(spark, d, max_mb=1)
    assert {os.path.basename(r.log_id): r.total_iocs_found for r in counts.collect()} == {"a.log": 1, "b.txt": 1, "c.json": 1, "empty.log": 0}
    assert [os.path.basename(r.path) for r in over.collect()] == ["big.log"]
    rej = {os.path.basename(r.path): r.reason for r in rejected.collect()}
    assert rej == {"big.log": "FILE_TOO_LARGE"}


def test_stream_windows_equal_batch_for_closed_windows(spark, sf):
    lines = inputs.seclog_chunks(spark, sf)
    d = tempfile.mkdtemp(prefix="seclog-stream-")
    lines.write.mode("overwrite").parquet(f"{d}/in")
    src = spark.readStream.schema(lines.schema).parquet(f"{d}/in")
    q = (
        stream_cluster_windows(src, decode="none")
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{d}/out")
        .option("checkpointLocation", f"{d}/chk")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    got = spark.read.parquet(f"{d}/out")
    batch = cluster_windows(cluster_key(suspicious(filter_chunks(lines, decode="none")))).drop("representative_chunk")
    # rows the stream may emit: windows closed by the final watermark
    wm = lines.agg(F.max("ts")).first()[0]
    emitted = {tuple(r) for r in got.select(*batch.columns).collect()}
    expected = {tuple(r) for r in batch.collect()}
    assert emitted <= expected
    closed = {r for r in expected if r[2] is not None and (wm - r[2]).total_seconds() >= 600}
    assert closed <= emitted


def test_streams_see_empty_files(spark, tmp_path):
    """The stream's rows are those of the batch, over several runs, one of them with empty files only."""
    src, out, chk = (str(tmp_path / d) for d in ("in", "out", "chk"))
    os.makedirs(f"{src}/deep er/x")
    steps = [{"a.log": b"src 10.0.0.1 cmd.exe", "b.log": b"", "skip.bin": b""}, {"deep er/x/c+1.log": b"", "e.txt": b""}, {"f.json": b"plain", "deep er/g.log": b""}]
    for step in steps:
        for name, data in step.items():
            _write(src, name, data)
        stream_logs(spark, src, out, chk, decode="none").awaitTermination()
    streamed = sorted((r.log_id, r.total_chunks_processed, r.suspicious_chunks) for r in spark.read.parquet(f"{out}/runs").collect())
    batch = analyze_logs(logs_from_files(admit_logs(read_logs(spark, src))[0]), decode="none").runs
    assert streamed == sorted((r.log_id, r.total_chunks_processed, r.suspicious_chunks) for r in batch.collect())
    assert len(streamed) == 6 and sum(n == 0 for _, n, _ in streamed) == 4


def test_files_are_listed_by_executors(spark, tmp_path):
    os.makedirs(tmp_path / "a b" / "c")
    os.makedirs(tmp_path / "_hidden")
    for name in ("x.log", "a b/y.log", "a b/c/z.log", "_hidden/w.log", "a b/.h.log"):
        _write(tmp_path, name, b"12")
    got = {r.path: r.length for r in list_files(spark, str(tmp_path)).collect()}
    read = {r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).collect()}
    assert set(got) == read and len(got) == 3 and set(got.values()) == {2}
    assert list_files(spark, str(tmp_path), recursive=False).count() == 1


def test_responses_quarantine_and_bucketed_join(spark, sf, tmp_path):
    rows = [("ip", "1.2.3.4", 200, '{"a": 1}'), ("ip", "1.2.3.5", 200, '{"a": '), ("ip", None, 200, "{}"), ("ip", "1.2.3.6", None, "{}"), ("ip", "1.2.3.7", 404, "not json"), ("ip", "1.2.3.8", 200, None)]
    spark.createDataFrame([(*r, "2024-01-30 23:30:00") for r in rows], "ioc_type string, ioc_value string, http_status int, body string, fetched_at string").write.parquet(f"{tmp_path}/raw")
    good, bad = read_responses(spark, f"{tmp_path}/raw", ["ioc_type", "ioc_value"])
    assert {r.ioc_value for r in good.collect()} == {"1.2.3.4", "1.2.3.7", "1.2.3.8"}
    assert sorted(r.reason for r in bad.collect()) == ["corrupt_body", "missing_key", "missing_status"]
    snap = write_snapshot(good, "seclog_test_snapshot", f"{tmp_path}/table", ["ioc_type", "ioc_value"], buckets=8)
    asked = spark.range(1000).select(F.when(F.col("id") % 2 == 0, F.lit("ip")).otherwise(F.lit("hash")).alias("ioc_type"), F.concat(F.lit("1.2.3."), (F.col("id") % 10).cast("string")).alias("ioc_value")).repartition(3)
    joined = asked.hint("merge").join(snap, ["ioc_type", "ioc_value"], "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert joined.where("http_status is not null").count() == 200
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1  # the indicators alone
    spark.sql("drop table seclog_test_snapshot")


def test_worklist_state_over_batches(spark, tmp_path):
    import datetime as dt
    import random

    rng, base = random.Random(4), dt.datetime(2024, 1, 1)
    events = sorted((rng.randrange(0, 5 * 3600), rng.choice(["1.1.1.1", "2.2.2.2", "x.io"])) for _ in range(300))
    want = []
    for value in {v for _, v in events}:
        last = None
        for t, v in events:
            if v == value and (last is None or t >= last + 3600):
                want.append((value, base + dt.timedelta(seconds=t)))
                last = t
    for part in range(3):
        rows = events[part * 100 : part * 100 + 100]
        rng.shuffle(rows)
        spark.createDataFrame([("domain" if v == "x.io" else "ipv4", v, base + dt.timedelta(seconds=t)) for t, v in rows] + [("mutex", "m", base)], "type string, value string, ts timestamp").write.mode("append").parquet(f"{tmp_path}/in")
        stream = stream_worklist(spark.readStream.schema("type string, value string, ts timestamp").parquet(f"{tmp_path}/in"))
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/chk").trigger(availableNow=True).start().awaitTermination()
    got = [(r.ioc_value, r.asked_at) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted(want)
