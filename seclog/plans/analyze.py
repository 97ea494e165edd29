"""Whole jobs: log-file analysis (E1), indicator-only extraction (E2) and
knowledge-base indexing (E4), composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..operators import kb
from ..operators.chunking import chunk_text, spread
from ..operators.funnel import cluster_counts, cluster_events, cluster_ids, cluster_key, count_whole, filter_chunks, merged_iocs, merged_keys, run_rows, run_summary, suspicious
from ..operators.verdicts import attach_verdicts
from ..session import cut_lineage
from ..sources.logs import admit_logs, logs_from_files, read_logs


@dataclass
class Analysis:
    runs: DataFrame
    clusters: DataFrame
    merged: DataFrame
    events: DataFrame | None


def analyze_logs(
    logs: DataFrame,
    decode: str = "reference",
    verdicts: DataFrame | None = None,
    chunk_size: int = rules.ANALYSIS_CHUNK_SIZE,
    context: int | None = rules.CONTEXT_WINDOW,
) -> Analysis:
    """E1 over ``logs(log_id, text)``: chunk → rule filter → suspicious →
    clusters → merged indicators → (verdicts) → one run row per log.

    The keys and indicators of the chunks are written once to the checkpoint folder (without the texts, which are
    cut again for the first chunks of clusters alone), since all outputs read them; run rows read no text.
    ``context=None``: the merged indicators have no contexts, for callers that do not show them. ``log_id`` is unique.
    """
    cut = chunk_text(logs, keys=["log_id"], size=chunk_size)
    judged = cut_lineage(cluster_key(filter_chunks(spread(cut), decode=decode, context=context)).select("log_id", "chunk_ix", "cluster_id", "keyword_hits", "iocs", "is_suspicious"))
    keyed = suspicious(judged).drop("is_suspicious")
    clusters = cluster_events(keyed, chunks=cut)
    merged = merged_iocs(keyed)
    chunks = judged.groupBy("log_id").agg(F.count(F.lit(1)).alias("total_chunks_processed"))
    totals = logs.select("log_id").join(chunks, "log_id", "left")
    events = None
    if verdicts is not None:
        events = attach_verdicts(clusters, verdicts)
        counts = merged_keys(keyed).groupBy("log_id", "cluster_id").agg(F.count(F.lit(1)).alias("_n"))
        events = events.join(counts, ["log_id", "cluster_id"], "left").withColumn(
            "n_iocs", F.when(F.col("error").isNull(), F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)).cast("long")
        ).drop("_n")
        runs = run_summary(totals, None, cluster_counts(keyed), events.select("log_id", "cluster_id", "is_threat", "error", "n_iocs"))
    else:
        runs = run_summary(totals, None, cluster_counts(keyed))
    return Analysis(runs, clusters, merged, events)


def summarize_logs(logs: DataFrame, decode: str = "reference", chunk_size: int = rules.ANALYSIS_CHUNK_SIZE) -> DataFrame:
    """The run rows of :func:`analyze_logs` alone: one pass over the chunks, which only need their cluster."""
    ids = cluster_ids(spread(chunk_text(logs, keys=["log_id"], size=chunk_size)), decode=decode)
    per = ids.groupBy("log_id", "cluster_id").agg(F.count("*").alias("sample_count"))
    counts = per.groupBy("log_id").agg(
        F.sum("sample_count").alias("total_chunks_processed"),
        F.sum(F.when(F.col("cluster_id").isNotNull(), F.col("sample_count"))).alias("suspicious_chunks"),
        F.count("cluster_id").alias("clustered_events"),
    )
    return run_rows(logs.select("log_id").join(counts, "log_id", "left"))


def extract_iocs_job(logs: DataFrame, decode: str = "reference") -> DataFrame:
    """Per whole log text the number of its indicators: ``log_id, total_iocs_found``, clean logs included.
    The indicators themselves are the rows of :func:`..operators.funnel.extract_whole`."""
    counts = count_whole(logs, decode=decode)
    return logs.select("log_id").join(counts, "log_id", "left").select("log_id", F.coalesce("total_iocs_found", F.lit(0)).cast("long").alias("total_iocs_found"))


def extract_iocs_files(spark: SparkSession, path: str, decode: str = "reference", max_mb: int = rules.IOC_ONLY_MAX_MB) -> tuple[DataFrame, DataFrame]:
    """E2 over log files of at most ``max_mb`` MiB: (counts per file, rejected files)."""
    accepted, rejected = admit_logs(read_logs(spark, path), max_mb)
    return extract_iocs_job(logs_from_files(accepted), decode), rejected


def index_kb(files: DataFrame, existing: DataFrame | None = None, embed=None, replace: bool = False):
    """(new KB table, per-file report) for ``files(file_order, file_id, source, content)``."""
    new = kb.kb_new_docs(files, existing)
    chunks = kb.kb_chunks(new, embed=embed)
    table = kb.kb_upsert(existing, chunks, replace=replace)
    return table, kb.kb_index_report(files, chunks, existing)
