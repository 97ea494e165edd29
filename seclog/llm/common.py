"""Helpers shared by the operators of this package."""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage  # noqa: F401  (re-exported to the operators)

#: Bytes that a worker may spend on what it remembers of earlier texts.
REMEMBERED_BYTES = 32 << 20


class Remembered:
    """Whole numbers by text, made on first use and forgotten when they take too much.

    ``make(texts)`` gives how many numbers each text has, and the numbers of all. Of two generations the elder goes when
    the younger holds half of ``limit`` bytes; what is used passes to the younger.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = REMEMBERED_BYTES):
        self.make, self.limit = make, limit
        self._begin()
        self._elder = self._place, self._ends, self._values

    def _begin(self) -> None:
        self._place: dict[str, int] = {}
        self._ends, self._values, self.held = array("q", [0]), array("i"), 0

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What ``make`` gives for these texts."""
        if self.held > self.limit // 2:
            self._elder = self._place, self._ends, self._values
            self._begin()
        if new := set(texts).difference(self._place):
            elder, *rows = self._elder
            old = [t for t in new if t in elder]
            self._add(old, *_rows(*rows, np.fromiter(map(elder.__getitem__, old), np.int64, len(old))))
            fresh = [t for t in new if t not in elder]
            self._add(fresh, *self.make(fresh))
        return _rows(self._ends, self._values, np.fromiter(map(self._place.__getitem__, texts), np.int64, len(texts)))

    def _add(self, texts: list[str], counts: np.ndarray, values: np.ndarray) -> None:
        first = len(self._ends) - 1
        self._place.update(zip(texts, range(first, first + len(texts))))
        self._ends.frombytes((self._ends[-1] + np.cumsum(counts, dtype=np.int64)).tobytes())
        self._values.frombytes(np.asarray(values).astype(np.intc).tobytes())
        # a text, its number and its place in the table, and what was made of it
        self.held += 200 * len(texts) + 2 * sum(map(len, texts)) + 4 * len(values)


def _rows(ends: array, values: array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of the runs with these numbers, one after the other."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.intc)
    end = np.frombuffer(ends, np.int64)
    first, count = end[at], end[at + 1] - end[at]
    flat = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return count, np.frombuffer(values, np.intc)[flat] if len(values) else np.zeros(0, np.intc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark (any path or store that Spark can read)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Lets Arrow batches of this session hold at most so many rows and bytes: whole texts are long, and the defaults of ten
    thousand rows and 64 MiB would take a worker's memory. Spark reads these settings when it plans a job, so they stay
    set; smaller ones are left alone, and results do not depend on them."""
    for name, most, unit in (("maxRecordsPerBatch", rows, ""), ("maxBytesPerBatch", size, "b")):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, f"{most}{unit}")


def id_fold(key: Column, folds: int) -> Column:
    """``crc32(key as text) mod folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def utf8(text: Column) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (compared without case), made from ``name``."""
    taken = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out.lower() in taken:
        out += "_"
    return out


def whole_row_hash(df: DataFrame) -> Column:
    """128 bits over every column of a row: rows with the same value are repeated rows (that two different ones have one value
    is out of reach of any corpus: with 10^10 rows the chance is below 10^-18)."""
    return F.unhex(F.md5(F.to_json(F.struct(*[df[f"`{c}`"] for c in df.columns]), {"ignoreNullFields": "false"}).cast("binary")))


def with_small(big: DataFrame, small: DataFrame, on: list[str], how: str, max_rows: int = 20_000) -> DataFrame:
    """Join with a side that is already written (counting it is cheap): it is broadcast only if the count
    is within ``max_rows``; otherwise Spark shuffles and AQE splits skewed keys."""
    return big.join(F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small, on, how)


def ranked(df: DataFrame, group: str, order: list[Column], rank: str) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each ``group`` (nulls are a group) in the order of ``order``.

    Two passes and no task that holds a whole group: rows are range-partitioned by (group, order), each
    partition numbers its own rows, and the partitions' counts (one row for each partition and group) give
    the offsets. Rows alike in every order column are told apart by a row number, so they can be split too.
    """
    spark, at, own, base, copy = df.sparkSession, fresh(df, "part"), fresh(df, "own"), fresh(df, "base"), fresh(df, "copy")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"`{group}`").asc_nulls_last(), *order, F.col(copy)]
    dealt = df.withColumn(copy, F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # written once: sampled range bounds may differ when a lost partition is made anew
    dealt = cut_lineage(dealt.withColumn(at, F.spark_partition_id()))
    g = F.struct(F.col(f"`{group}`"))  # a struct is never null, so null groups join
    counts = dealt.groupBy(g.alias("__g"), at).agg(F.count("*").alias("__n"))
    offsets = counts.withColumn(base, F.sum("__n").over(W.partitionBy("__g").orderBy(at)) - F.col("__n")).drop("__n")
    offsets = offsets.withColumnRenamed(at, "__at")
    numbered = dealt.withColumn(own, F.row_number().over(W.partitionBy(at, f"`{group}`").orderBy(*order, copy)) - 1)
    joined = numbered.join(offsets, (g == F.col("__g")) & (F.col(at) == F.col("__at")))
    return joined.withColumn(rank, F.col(own) + F.col(base)).drop(at, own, base, copy, "__g", "__at")
