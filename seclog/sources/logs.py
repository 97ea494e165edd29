"""Log-file sources: binary scan with empty files, admission, charset decoding, KB documents,
raw responses with a quarantine, bucketed snapshots, and the JSON result sink."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from .. import rules
from ..functions.text import base_name
from ..session import cut_lineage

BINARY_FILE_SCHEMA = StructType(
    [
        StructField("path", StringType(), False),
        StructField("modificationTime", TimestampType(), False),
        StructField("length", LongType(), False),
        StructField("content", BinaryType(), True),
    ]
)


def _glob(extensions) -> str:
    return "*.{" + ",".join(extensions) + "}"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What directories (column ``path``) hold: ``path, is_dir, length, modified``."""
    from pyarrow import fs

    names = ["path", "is_dir", "length", "modified"]
    for b in batches:
        for uri in b.column(0).to_pylist():
            # the store by its name alone: a path may hold what a URI may not
            head, at = re.fullmatch(r"(\w+://[^/]*)(/?.*)", uri, re.DOTALL).groups()
            store, top = fs.FileSystem.from_uri(head + "/")
            top = top.rstrip("/")
            found = store.get_file_info(fs.FileSelector(top + at or "/", recursive=False))
            for i in range(0, len(found), 10_000):
                part = found[i : i + 10_000]
                cols = [[head + f.path[len(top) :] for f in part], [f.type == fs.FileType.Directory for f in part], [f.size or 0 for f in part], [f.mtime for f in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")))], names)


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``path, length, modified`` of the files below a directory, listed by executors level by level: no list of files passes
    the driver, which only counts the directories of a level. Names that begin with ``_`` or ``.`` are left out, as Spark's
    sources do. ``path`` is a directory of a store that pyarrow knows (local, hdfs, s3, gs, abfs)."""
    root = path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:"))
    level, files = spark.createDataFrame([(root.rstrip("/"),)], "path string"), None
    hidden = F.regexp_extract("path", "[^/]*$", 0).rlike("^[_.]")
    while True:
        found = cut_lineage(level.mapInArrow(_entries, "path string, is_dir boolean, length long, modified timestamp").where(~hidden))
        here = found.where("not is_dir").drop("is_dir")
        files = here if files is None else files.unionByName(here)
        level = found.where("is_dir").select("path")
        if not recursive or level.isEmpty():
            break
        level = level.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    # as Hadoop writes local paths
    return files.withColumn("path", F.regexp_replace("path", "^file:///", "file:/"))


def read_logs(
    spark: SparkSession,
    path: str,
    extensions=tuple(rules.LOG_EXTENSIONS),
    recursive: bool = True,
) -> DataFrame:
    """``binaryFile`` scan: one row per file (``path, modificationTime, length, content``).

    A file is never split, so each log is whole in one row; many files give
    many tasks. Filters on ``length`` are applied before content is read.
    Zero-length files, which the binaryFile source leaves out, are added with empty content from a listing that
    executors make (see :func:`list_files`).
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", _glob(extensions))
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.load(path)
    return files.unionByName(_as_empty(list_files(spark, path, recursive).where("length = 0"), extensions))


def _as_empty(listed: DataFrame, extensions) -> DataFrame:
    """Rows of ``binaryFile`` for the listed files (``path, modified``) with one of the extensions."""
    wanted = listed.where(base_name(F.col("path")).rlike(r"\.(?:" + "|".join(map(re.escape, extensions)) + r")\z"))
    return wanted.select("path", F.col("modified").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


def admit_logs(files: DataFrame, max_mb: int = rules.LOG_MAX_MB) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a file needs a name and at most ``max_mb`` MiB.

    Rejected rows keep ``path, length, reason`` (FILE_TOO_LARGE / MISSING_FILENAME).
    """
    limit = max_mb * 1024 * 1024
    reason = (
        F.when(base_name(F.col("path")) == "", F.lit(rules.REJECT_MISSING_NAME))
        .when(F.col("length") > limit, F.lit(rules.REJECT_TOO_LARGE))
    )
    accepted = files.where((F.col("length") <= limit) & (base_name(F.col("path")) != ""))
    rejected = files.select("path", "length", reason.alias("reason")).where(F.col("reason").isNotNull())
    return accepted, rejected


@F.pandas_udf(StringType())
def _gbk(s: pd.Series) -> pd.Series:
    """Texts of GBK bytes; null where the bytes are not GBK."""
    decoded = s.map(lambda b: None if b is None else b.decode("gbk", "replace"))
    return decoded.where(~decoded.str.contains("\ufffd", regex=False, na=True), None)


def _latin1(content: Column) -> Column:
    """Each byte is the code point of the same number."""
    return F.decode(content, "ISO-8859-1")


def decode_bytes(content: Column) -> Column:
    """Charset ladder UTF-8 → GBK → Latin-1.

    Valid UTF-8 (the common case) is decoded by a JVM cast and Latin-1 by the JVM too; only the
    other rows are shipped (as Arrow batches) to Python's GBK codec.
    """
    as_text = content.cast("string")
    valid = F.is_valid_utf8(as_text)
    return F.when(valid, as_text).otherwise(F.coalesce(_gbk(F.when(~valid, content)), _latin1(content)))


def logs_from_files(files: DataFrame) -> DataFrame:
    """``log_id`` (the path) and decoded ``text`` per admitted file."""
    return files.select(F.col("path").alias("log_id"), decode_bytes(F.col("content")).alias("text"))


def read_kb_docs(spark: SparkSession, path: str, file_id: str | None = None, recursive: bool = False) -> DataFrame:
    """KB documents: whole UTF-8 files as ``file_order, file_id, source, content``."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive)
    p = F.col("_metadata.file_path")
    return df.select(
        p.alias("file_order"),
        F.lit(file_id or rules.KB_DEFAULT_FILE_ID).alias("file_id"),
        base_name(p).alias("source"),
        F.col("value").alias("content"),
    )


CORRUPT_BODY, MISSING_KEY, MISSING_STATUS = "corrupt_body", "missing_key", "missing_status"


def read_responses(spark: SparkSession, path: str, keys: Sequence[str], fmt: str = "parquet", schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(responses, quarantine) of a raw lookup-response table ``keys…, http_status, body, fetched_at``.

    A row without one of its keys or without a status, or one that succeeded (200) with a body that is no JSON, goes to
    the quarantine with its ``reason``; the others are returned as they are.
    """
    reader = spark.read.format(fmt)
    rows = (reader.schema(schema) if schema else reader).load(path)
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    reason = (
        F.when(no_key, F.lit(MISSING_KEY))
        .when(F.col("http_status").isNull(), F.lit(MISSING_STATUS))
        .when((F.col("http_status") == 200) & F.col("body").isNotNull() & F.try_parse_json("body").isNull(), F.lit(CORRUPT_BODY))
    )
    # out of a generator, so that the body is parsed once and the two filters read the result
    judged = rows.select("*", F.inline(F.array(F.struct(reason.alias("reason")))))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def write_snapshot(snapshot: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int = 64) -> DataFrame:
    """A snapshot as table ``name`` in ``path``, bucketed by its keys: a join on these keys reads it without a shuffle, only the
    other side is exchanged. Returns the table."""
    writer = snapshot.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return snapshot.sparkSession.table(name)


def write_result(runs: DataFrame, path: str, events: DataFrame | None = None, iocs: DataFrame | None = None, mode: str = "overwrite") -> None:
    """JSON-lines sink: ``runs/`` one object per log, ``events/`` one per event, ``iocs/`` one per indicator of an event (rows with
    its keys, so that no event becomes one giant object)."""
    for name, rows in (("runs", runs), ("events", events), ("iocs", iocs)):
        if rows is not None:
            rows.write.mode(mode).json(f"{path.rstrip('/')}/{name}")
