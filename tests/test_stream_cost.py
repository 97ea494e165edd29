"""The stream's run rows come from the judged chunks; texts are read for clusters only and no contexts are made."""

from seclog.plans.analyze import analyze_logs
from seclog.streaming import intake

LOGS = [("a", "x" * 4001 + " evil.xyz"), ("b", ""), ("c", None), ("d", "\U0001f600" * 4000), ("e", "cmd.exe " * 1001)]


def test_run_rows_read_no_text(spark):
    logs = spark.createDataFrame(LOGS, "log_id string, text string")
    a = analyze_logs(logs, decode="none", context=None)
    rows = {r.log_id: (r.total_chunks_processed, r.suspicious_chunks, r.clustered_events) for r in a.runs.collect()}
    assert rows == {"a": (2, 1, 1), "b": (0, 0, 0), "c": (0, 0, 0), "d": (1, 0, 0), "e": (3, 3, 1)}
    plan = a.runs._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "length(text" not in plan
    assert {r.context for r in a.merged.collect()} == {None}


def test_stream_makes_no_contexts(spark, tmp_path, monkeypatch):
    seen, real = [], intake.analyze_logs
    monkeypatch.setattr(intake, "analyze_logs", lambda logs, **how: seen.append(how) or real(logs, **how))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.log").write_text("mail from x@mail1.bad.top")
    intake.stream_logs(spark, str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "chk"), decode="none").awaitTermination()
    assert [h["context"] for h in seen] == [None]
    assert spark.read.parquet(str(tmp_path / "out/runs")).first().suspicious_chunks == 1
