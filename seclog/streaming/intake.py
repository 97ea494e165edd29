"""Structured Streaming jobs.

* :func:`stream_logs` — continuous intake of log files: ``readStream`` of
  ``binaryFile`` → admission → charset decode → per micro-batch the batch
  analysis (E1) → idempotent parquet append keyed by batch id. Every file is
  whole inside one micro-batch, so per-log clustering needs no state.
* :func:`stream_verdicts` — clusters joined with the responses that arrive later.
* :func:`stream_worklist` — what to look up, each key once per time to live.
* :func:`stream_cluster_windows` — event-time clustering of log lines in
  300-second tumbling windows with a watermark; late rows are dropped by the
  watermark, windows are emitted once closed (append mode).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import rules
from ..operators.funnel import cluster_key, filter_chunks, suspicious
from ..operators.intel import routable_iocs
from ..operators.verdicts import parse_verdicts
from ..plans.analyze import analyze_logs
from ..session import cut_lineage
from ..sources.logs import BINARY_FILE_SCHEMA, _as_empty, _glob, admit_logs, logs_from_files


def stream_logs(
    spark: SparkSession,
    source_dir: str,
    out_dir: str,
    checkpoint: str,
    decode: str = "reference",
    max_mb: int = rules.LOG_MAX_MB,
    available_now: bool = True,
    extensions=tuple(rules.LOG_EXTENSIONS),
):
    """Start the intake stream; returns the ``StreamingQuery``.

    Output: ``out_dir/runs`` and ``out_dir/clusters`` (parquet, one folder
    per micro-batch id, overwritten on replay → exactly-once results) and
    ``out_dir/rejected``. Empty files, which the source counts but gives no row for, come from the stream's own record of
    the batch's files.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("pathGlobFilter", _glob(extensions))
        .option("recursiveFileLookup", "true")
        .load(source_dir)
    )

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # listed once, not by each output
        batch = batch.unionByName(cut_lineage(_empty_files(spark, checkpoint, batch_id, batch, extensions)))
        accepted, rejected = admit_logs(batch, max_mb)
        logs = logs_from_files(accepted)
        a = analyze_logs(logs, decode=decode, context=None)  # the judged chunks are written once for both outputs, which show no contexts
        base = out_dir.rstrip("/")
        a.runs.write.mode("overwrite").parquet(f"{base}/runs/batch_id={batch_id}")
        a.clusters.write.mode("overwrite").parquet(f"{base}/clusters/batch_id={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{base}/rejected/batch_id={batch_id}")

    writer = files.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")
    return writer.start()


def _empty_files(spark: SparkSession, checkpoint: str, batch_id: int, batch: DataFrame, extensions) -> DataFrame:
    """Rows for the files of a micro-batch that the source recorded but gave no row for: those without a byte.

    The stream's checkpoint says which entries of the source's file log belong to the batch; the log is read by Spark.
    """
    log = checkpoint.rstrip("/")

    def upto(batch: int) -> int:
        if batch < 0:
            return -1
        lines = spark.read.text(f"{log}/offsets/{batch}").where("value like '%logOffset%'").select(F.get_json_object("value", "$.logOffset").cast("int")).collect()
        return lines[0][0] if lines else -1  # one source, one line

    first, last = upto(batch_id - 1), upto(batch_id)
    entries = spark.read.text(f"{log}/sources/0").where("value like '{%'").select(F.from_json("value", "path string, timestamp long, batchId long").alias("e")).select("e.*")
    # the log holds URIs
    path = F.regexp_replace(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")
    mine = entries.where((F.col("batchId") > first) & (F.col("batchId") <= last)).select(path.alias("path"), F.timestamp_millis("timestamp").alias("modified")).distinct()
    return _as_empty(mine.join(batch.select("path"), "path", "left_anti"), extensions)


def stream_verdicts(clusters: DataFrame, responses: DataFrame, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Streaming J4: ``clusters(log_id, cluster_id, seen_at, …)`` joined with raw ``responses(log_id, cluster_id, raw, answered_at)`` that
    arrive up to ``wait`` after the cluster was seen.

    A left outer join with watermarks on both sides: an answered cluster comes out when its response does, one that is not
    answered in time comes out once the watermarks have passed its limit, with the error of a missing response. State is
    kept for ``wait`` and ``late`` only. Output of append mode: the clusters' columns, the verdict's and ``error``.
    """
    names = clusters.columns
    left = clusters.withWatermark("seen_at", late)
    right = responses.select(F.col("log_id").alias("_l"), F.col("cluster_id").alias("_c"), "raw", "answered_at").withWatermark("answered_at", late)
    in_time = (F.col("answered_at") >= F.col("seen_at")) & (F.col("answered_at") <= F.col("seen_at") + F.expr(f"interval {wait}"))
    joined = left.join(right, (F.col("log_id") == F.col("_l")) & (F.col("cluster_id") == F.col("_c")) & in_time, "left_outer")
    # a cluster without a response is like one with an empty one: its verdict cannot be parsed
    return parse_verdicts(joined.select(*names, F.coalesce("raw", F.lit("")).alias("raw")), keep=names)


_ASKS = "ioc_type string, ioc_value string, asked_at timestamp"


def _ask(ttl_sec: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # the key's times in this batch, in order; each is a few bytes
        times = np.sort(np.concatenate([b["ts"].to_numpy("datetime64[us]") for b in batches])).astype(np.int64)
        last = state.get[0] if state.exists else None
        out, ttl = [], ttl_sec * 1_000_000
        while len(times):
            if last is not None:
                times = times[np.searchsorted(times, last + ttl) :]
                if not len(times):
                    break
            last = int(times[0])
            out.append(last)
        state.update((last,))
        # forgotten when nothing in time can fall within the time to live any more
        state.setTimeoutTimestamp(max(last // 1000 + ttl_sec * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"ioc_type": key[0], "ioc_value": key[1], "asked_at": np.array(out, "datetime64[us]")})

    return run


def stream_worklist(iocs: DataFrame, ttl_sec: int = rules.REPUTATION_TTL_SEC, ts_col: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Streaming C11: indicator rows ``type, value, ts`` to ``ioc_type, ioc_value, asked_at``: a routable key is asked for when it is first
    seen and again when it is seen at least ``ttl_sec`` after it was last asked for.

    Keyed state holds one time for each key and is dropped after the time to live. Rows of a micro-batch may come in any
    order; rows later than the watermark are dropped.
    """
    rows = routable_iocs(iocs).where(F.col("route").isNotNull()).select(F.col("route").alias("ioc_type"), F.col("value").alias("ioc_value"), F.col(ts_col).cast("timestamp").alias("ts"))
    keyed = rows.withWatermark("ts", late).groupBy("ioc_type", "ioc_value")
    return keyed.applyInPandasWithState(_ask(ttl_sec), _ASKS, "asked_us long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_cluster_windows(
    lines: DataFrame,
    seconds: int = rules.EVENT_TIME_WINDOW_SEC,
    watermark: str = "10 minutes",
    ts_col: str = "ts",
    decode: str = "reference",
) -> DataFrame:
    """Streaming windowed clusters over ``lines(log_id, chunk_ix, chunk, ts)``."""
    keyed = cluster_key(suspicious(filter_chunks(lines, decode=decode)))
    ts_type = lines.schema[ts_col].dataType.simpleString()
    # watermarks need TIMESTAMP; a TIMESTAMP_NTZ column is read as UTC wall time
    keyed = keyed.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return (
        keyed.withWatermark(ts_col, watermark)
        .groupBy("log_id", F.window(F.col(ts_col), f"{seconds} seconds").alias("w"), "cluster_id")
        .agg(F.count(F.lit(1)).alias("sample_count"), F.min("chunk_ix").alias("first_chunk_ix"))
        .select(
            "log_id",
            F.col("w.start").cast(ts_type).alias("window_start"),
            F.col("w.end").cast(ts_type).alias("window_end"),
            "cluster_id",
            "sample_count",
            "first_chunk_ix",
        )
    )
