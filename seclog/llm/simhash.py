"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprint: a text's A-Z are lower-cased; words are runs of ``[^\\x20\\x09-\\x0D]``; a shingle is ``k``
words joined by one space (a shorter text is one shingle of all its words). A bit is 1 if it is set in
over half of the shingles' XXH64 (seed 42), repeats included. A text without words (null, empty, blank)
has fingerprint zero and is linked like any other.

Covering masks: each of the 64 bits gets a nonzero-or-zero label of ``radius + 1`` bits, dealt round
robin, and each of the ``2**(radius+1) - 1`` nonzero vectors v gives a mask: the bits whose label has an
odd inner product with v. The at most ``radius`` labels of the bits in which two fingerprints differ
cannot span all vectors, so some v is orthogonal to each: under its mask the two are equal. Every pair
within the radius thus collides in some table, without exception.

A bucket of up to ``BUCKET`` distinct fingerprints is compared inside one task. The members of a larger
one go on to a further level, which covers the bits that the bucket's mask left open in the same way, so
that each level halves the open bits (64, 32, 16, 8 at radius 3). After the last level a bucket has fewer open bits
than ``BUCKET`` has values, so no bucket is cut short and no pair is lost. From each bucket a spanning forest of
its links goes on, never the pairs. Connected components come from alternating star contraction.

Equal fingerprints are one node, so a group of exact copies costs one row. A null key is never a
component's id unless all its members have null keys. Repeated rows come back as often as they came.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, fresh, table, text_batches, utf8, whole_row_hash

SEED = 42
#: Shingles hashed at once.
BLOCK = 1 << 15
#: Distinct fingerprints that one task compares with each other.
BUCKET = 256


def fingerprint_of(data: bytes, k: int) -> int:
    """The 64-bit fingerprint of a text's UTF-8 bytes."""
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    hashed, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), max(1, len(words) - k + 1)
    for start in range(0, n, BLOCK):
        part = words[start : start + BLOCK + k - 1]
        shingles = map(b" ".join, zip(*(itertools.islice(part, i, None) for i in range(k)))) if len(words) >= k else [b" ".join(words)]
        h = np.fromiter((hashed(s, SEED) for s in shingles), np.uint64)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: Column, k: int) -> Column:
    """The fingerprint as a signed 64-bit integer (Spark has no unsigned ones)."""

    @F.arrow_udf(T.LongType())
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t.as_py(), k) for t in texts], np.uint64).view(np.int64), pa.int64())

    return prints(utf8(text))


def masks(radius: int, levels: int) -> list[list[int]]:
    """Masks by level; at level i, mask ``p`` refines mask ``p // (2**(radius+1) - 1)`` of level i - 1."""
    size = 1 << (radius + 1)
    out, last = [], [0]
    for _ in range(levels):
        now = []
        for mask in last:
            free = [b for b in range(64) if not mask >> b & 1]
            for v in range(1, size):
                now.append(mask | sum(1 << b for i, b in enumerate(free) if (i % size & v).bit_count() & 1))
        out.append(now)
        last = now
    return out


def _levels(radius: int) -> int:
    """Levels until the bits that a bucket leaves open number at most log2(BUCKET)."""
    levels = 1
    while max(64 - m.bit_count() for m in masks(radius, levels)[-1]) > BUCKET.bit_length() - 1:
        levels += 1
    return levels


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints (at most BUCKET of them)."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    edges, left = [], np.ones(len(fps), bool)
    for i in range(len(fps)):
        if not left[i]:
            continue
        left[i], front = False, [i]
        while front:
            j = front.pop()
            new = np.flatnonzero(near[j] & left)
            left[new] = False
            edges += [(j, x) for x in new.tolist()]
            front += new.tolist()
    return edges


def _linked(radius: int):
    """mapInArrow over rows (path, bucket, fp) sorted by bucket: the forest edges (a, b) of each bucket."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def bucket(fps: np.ndarray) -> Iterator[tuple[int, int]]:
        signed = fps.view(np.int64)
        for i, j in _forest(fps, radius):
            yield tuple(sorted((int(signed[i]), int(signed[j]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 3
        for cols in itertools.chain((([c.to_numpy() for c in b.columns]) for b in batches), [None]):
            last = cols is None
            path, key, fp = rest if last else [np.concatenate([r, c]) for r, c in zip(rest, cols)]
            starts = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (key[1:] != key[:-1])]) if len(path) else np.empty(0, np.int64)
            ends = np.r_[starts[1:], len(path)]
            if not last and len(starts):  # the last bucket may go on in the next batch; it has BUCKET rows at most
                rest = [path[starts[-1] :], key[starts[-1] :], fp[starts[-1] :]]
                starts, ends = starts[:-1], ends[:-1]
            found = [e for s, t in zip(starts.tolist(), ends.tolist()) if t - s > 1 for e in bucket(fp[s:t].view(np.uint64))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], schema=schema)

    return run


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Edges ``a < b`` between distinct fingerprints (column ``fp``) that join all pairs within ``radius`` bits:
    within each bucket a spanning forest, so connectivity is that of all the pairs."""
    per, out = (1 << (radius + 1)) - 1, None
    rows = prints.select(F.lit(0).alias("path"), "fp")
    for level in masks(radius, _levels(radius)):
        table_of = F.array(*[F.lit(_signed(m)) for m in level])
        tried = rows.select(F.explode(F.sequence(F.col("path") * per, F.col("path") * per + per - 1)).alias("path"), "fp")
        tried = tried.withColumn("bucket", F.col("fp").bitwiseAND(F.element_at(table_of, F.col("path") + 1)))
        sizes = tried.groupBy("path", "bucket").agg(F.count("*").alias("n")).where("n > 1")
        met = tried.join(sizes, ["path", "bucket"])
        small = met.where(F.col("n") <= BUCKET).select(F.col("path").cast("long").alias("path"), "bucket", "fp")
        small = small.repartition("path", "bucket").sortWithinPartitions("path", "bucket", "fp")
        edges = small.mapInArrow(_linked(radius), "a long, b long")
        out = edges if out is None else out.unionByName(edges)
        rows = cut_lineage(met.where(F.col("n") > BUCKET).select("path", "fp"))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for each node of an edge.

    Alternating large-star and small-star contraction: each step hangs neighbours on the smallest one and
    works on rows of edges only, so a node of any degree is no list in any task. Ends when a step changes nothing.
    """

    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hung = both.join(least, "a")
        new = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if larger else hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return new.where(F.col("a") != F.col("b")).distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = state(now)
    while before[0]:
        now = cut_lineage(star(star(now, True), False))
        after = state(now)
        if after == before:
            break
        before = after
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, key: Column, k: int = 3, radius: int = 3, text: str = "text") -> DataFrame:
    """``key, fp, component``: for each row of ``docs`` its fingerprint and the smallest key that links reach from it.

    ``key`` may be any orderable expression. The result has one narrow row for each row of ``docs``.
    """
    text_batches(docs.sparkSession)
    printed = cut_lineage(docs.select(key.alias("key"), fingerprint(F.col(f"`{text}`"), k).alias("fp")))
    nodes = cut_lineage(printed.groupBy("fp").agg(F.min("key").alias("least")))
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = rooted.join(named, "root").select("fp", "component")
    return printed.join(classes, "fp").select("key", "fp", "component")


def keep_one(docs: DataFrame, k: int = 3, radius: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest ``doc_id`` (null ids last), and of
    rows with that id the one whose row hash is smallest; repeated rows count as one."""
    row = fresh(docs, "row")
    marked = docs.withColumn(row, whole_row_hash(docs))
    key = F.struct(F.col(f"`{doc_id}`").isNull().alias("last"), F.col(f"`{doc_id}`").alias("id"), F.col(row).alias("row"))
    kept = near_duplicates(marked, key, k, radius, text).select(F.col("component.row").alias(row)).distinct()
    # repeated rows are merged in the tasks that read them, so a row that a third of all are costs no task more than others
    return marked.dropDuplicates([row]).join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint (3-word shingles) and component (3 bits): ``doc_id, fingerprint, component_id``."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id"), k=3, radius=3)
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
