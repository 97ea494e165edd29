"""Inputs of the registered queries, derived by Spark from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from ..sources.fixtures import fixture
from ..sources.tables import table


def session(spark: SparkSession) -> SparkSession:
    return configure(spark)


def seclog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, ts, user_id, line`` — one log line per event."""
    return fixture(spark, "seclog", table(spark, sf_dir, "events"))


def seclog_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-shaped logs: ``log_id`` = user, one chunk per line, order key = event id."""
    return seclog_lines(spark, sf_dir).select(
        F.col("user_id").alias("log_id"),
        F.col("event_id").alias("chunk_ix"),
        F.col("line").alias("chunk"),
        "event_id",
        "ts",
    )


def text_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-shaped logs: every document and every page is one log text."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("log_id"), F.col("text")
    )
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("log_id"), F.col("html").alias("text")
    )
    return docs.unionByName(pages)


def verdict_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, "verdict_raw", table(spark, sf_dir, "events"))


def reputation_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, "reputation_raw", table(spark, sf_dir, "events"))


def registration_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, "registration_raw", table(spark, sf_dir, "events"))


def kb_document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as KB files: order = doc_id, a file_id for each but every fiftieth, which index one file again."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_order"),
        F.when(F.col("doc_id") % 50 == 0, F.lit("again")).otherwise(F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("file_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"),
        F.col("text").alias("content"),
    )


def kb_benchmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as the KB that already exists before indexing documents."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("file_order"),
        F.concat(F.lit("bench"), F.col("item_id").cast("string")).alias("file_id"),
        F.concat(F.lit("item_"), F.col("item_id").cast("string"), F.lit(".txt")).alias("source"),
        F.col("text").alias("content"),
    )


def embedding_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as KB chunks (``label`` is the file_id)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("file_id"), "embedding"
    )
