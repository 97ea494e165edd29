"""Hard-negative mining over zone-mapped blocks of vectors in the order of a Hilbert curve.

Candidates are sorted by label and by their place on a Hilbert curve through all dimensions, cut into blocks of
``BLOCK_ROWS`` neighbours and written as Parquet, a row for each block, with its zone map: the least and greatest value of
each dimension and of the label. The inner product of an anchor with any vector of a block lies between two sums of those
edges (interval arithmetic). A *window* asks for the ``k`` best scores of an anchor between ``lo`` and ``hi`` among rows of
its own label, or of others:

1. *Probe*: for each window the block with the greatest bound (of those a pack of zone maps shows) is read. The ``k``-th
   best score found is the window's floor.
2. *Finish*: of all other blocks those whose bounds reach into the window and to its floor are read. No other block can hold
   a result, so the result is exact.

Positives are one search with a window open at both ends, negatives a second one with a window for each positive.

Anchors travel in packs of ``PACK_ANCHORS``; a pack meets each pack of zone maps, and only the anchors that need one
of the 16 blocks of a segment are sent there. A segment is loaded once for ``SALT_PACKS`` packs.

Repeated rows (equal id, label and vector) count once. A row of the anchor's id is the anchor's own and never
its result; rows that share an id but differ are anchors and candidates each. Rows with a null id or label, with a null or
empty vector or with null or non-finite entries take no part; vectors of different lengths never meet. Ties go to the
smaller id. Other columns are left out whatever their names; an empty table gives an empty result. Whole-number
entries beyond the size at which an inner product would leave a long count as that size.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut_lineage, ranked, table, with_small

BLOCK_ROWS, SEGMENT_BLOCKS, ZONES, PACK_ANCHORS, SALT_PACKS = 256, 16, 1024, 1024, 16
#: Bits of each dimension that place a vector on the curve.
CURVE_BITS = 4
LEAST, MOST = -(2**63) + 1, 2**63 - 1


# ------------------------------------------------------------------ the curve and the blocks

def hilbert_keys(x: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Places on a Hilbert curve, as rows of bytes that sort like the curve, of points with whole coordinates below
    ``2 ** bits``."""
    x = x.astype(np.int64).copy()
    n, dims = x.shape
    q = 1 << bits - 1
    while q > 1:  # turn each sub-cube as the curve runs through it
        p = q - 1
        for i in range(dims):
            upper = (x[:, i] & q) != 0
            swap = np.where(upper, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(upper, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.int64)
    q = 1 << bits - 1
    while q > 1:
        turn ^= np.where(x[:, -1] & q, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)


def whole(vector: Column, scale: float) -> Column:
    """``floor(scale * entry)`` of each entry as longs, within the size at which no inner product leaves a long; null for a
    vector that is null or empty or holds null or non-finite entries."""
    fine = (F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    limit = F.floor(F.sqrt(F.lit(2.0**62) / F.greatest(F.size(vector), F.lit(1)))).cast("double")
    clip = lambda v: F.greatest(-limit, F.least(limit, F.floor(F.greatest(F.lit(-(2.0**60)), F.least(F.lit(2.0**60), v.cast("double") * scale))).cast("double")))
    return F.when(fine, F.transform(vector, lambda v: clip(v).cast("long")))


def _small(x: np.ndarray) -> np.ndarray:
    """The matrix in the smallest whole-number type that holds it."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def _put(x: np.ndarray) -> tuple[bytes, int]:
    x = _small(x)
    return x.tobytes(), x.itemsize


def _get(data: bytes, width: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"i{width}").reshape(-1, dim)


def _with_place(rows: DataFrame) -> DataFrame:
    """Adds ``place``, the bytes of the curve's key: each dimension in ``2 ** CURVE_BITS`` steps of the range of all."""
    edges = rows.groupBy("dim").agg(F.min(F.array_min("x")).cast("double").alias("lo"), F.max(F.array_max("x")).cast("double").alias("hi"))
    steps = (1 << CURVE_BITS) - 1
    step = lambda v: F.floor((v.cast("double") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0)) * steps).cast("int")

    @F.arrow_udf("binary")
    def keys(points: pa.Array) -> pa.Array:
        size, out = np.diff(np.asarray(points.offsets)), np.empty(len(points), object)
        for dim in np.unique(size).tolist():
            at = np.flatnonzero(size == dim)
            found = hilbert_keys(np.asarray(points.take(pa.array(at)).flatten()).reshape(len(at), dim))
            out[at] = [r.tobytes() for r in found]
        return pa.array(out, pa.binary())

    # a row for each vector length
    return with_small(rows, cut_lineage(edges), ["dim"], "inner").withColumn("place", keys(F.transform("x", step))).drop("lo", "hi")


BLOCK = "dim int, block long, n int, ids binary, labels binary, vectors binary, width int, label_lo long, label_hi long, zones binary, zone_width int"


def _block(t: pa.Table) -> pa.Table:
    ids, dim = t.column("vec_id").to_numpy(), t.column("dim")[0].as_py()
    order = np.argsort(ids, kind="stable")  # results take the first of equal scores
    labels = t.column("label").to_numpy()[order].astype(np.int64)
    x = np.asarray(t.column("x").combine_chunks().flatten(), np.int64).reshape(-1, dim)[order]
    vectors, zones = _put(x), _put(np.stack([x.min(axis=0), x.max(axis=0)]))
    one = [dim, t.column("block")[0].as_py(), len(ids), ids[order].astype(np.int64).tobytes(), labels.tobytes(), *vectors, int(labels.min()), int(labels.max()), *zones]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
    return pa.table([pa.array([v], k) for v, k in zip(one, kinds)], [c.split()[0] for c in BLOCK.split(", ")])


class Blocks:
    """The candidates as a Parquet table of blocks in the shared folder.

    ``rows``: ``vec_id long, label, x array<long>``. ``ordered`` holds the rows with their number ``row`` in the order of
    (label, curve) for each vector length.
    """

    def __init__(self, rows: DataFrame, block_rows: int = BLOCK_ROWS):
        spark = rows.sparkSession
        known = rows.select("vec_id", F.col("label").cast("long").alias("label"), "x").where("vec_id is not null and label is not null and x is not null")
        known = cut_lineage(known.distinct().withColumn("dim", F.size("x")))
        placed = ranked(_with_place(known), "dim", [F.col("label"), F.col("place"), F.col("vec_id")], "row").drop("place")
        self.ordered = cut_lineage(placed.withColumn("block", F.floor(F.col("row") / block_rows)))
        self.path = f"{checkpoint_dir(spark)}/negatives-{uuid.uuid4().hex}"
        self.ordered.groupBy("dim", "block").applyInArrow(_block, BLOCK).write.parquet(self.path)
        self.blocks = spark.read.schema(BLOCK).parquet(self.path).withColumn("segment", F.floor(F.col("block") / SEGMENT_BLOCKS))
        # the vectors' columns are not read for these
        zones = self.blocks.select("dim", "block", "label_lo", "label_hi", "zones", "zone_width", F.floor(F.col("block") / ZONES).alias("zone_pack"))
        self.zones = cut_lineage(zones.groupBy("dim", "zone_pack").applyInArrow(_zone_pack, ZONE_PACK))


ZONE_PACK = "dim int, zone_pack long, blocks binary, label_lo binary, label_hi binary, low binary, high binary"


def _zone_pack(t: pa.Table) -> pa.Table:
    dim = t.column("dim")[0].as_py()
    order = np.argsort(t.column("block").to_numpy())
    edges = np.stack([_get(z, w, dim) for z, w in zip(t.column("zones").to_pylist(), t.column("zone_width").to_pylist())]).astype(np.int64)[order]
    col = lambda name: t.column(name).to_numpy()[order].astype(np.int64).tobytes()
    one = [dim, t.column("zone_pack")[0].as_py(), col("block"), col("label_lo"), col("label_hi"), edges[:, 0].tobytes(), edges[:, 1].tobytes()]
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
    return pa.table([pa.array([v], k) for v, k in zip(one, kinds)], [c.split()[0] for c in ZONE_PACK.split(", ")])


# ------------------------------------------------------------------ which blocks

PACK = "dim int, pack long, rows binary, ids binary, labels binary, vectors binary, width int, windows int, lo binary, hi binary"


def _pack(t: pa.Table) -> pa.Table:
    """Anchors with their windows: a matrix of edges, empty windows where an anchor has fewer than another."""
    dim, order = t.column("dim")[0].as_py(), np.argsort(t.column("row").to_numpy())
    t = t.take(pa.array(order))
    lo, hi = t.column("lo").to_pylist(), t.column("hi").to_pylist()
    wide = max(map(len, lo))
    edges = [np.array([[*w, *[fill] * (wide - len(w))] for w in part], np.int64) for part, fill in ((lo, MOST), (hi, LEAST))]
    x = np.asarray(t.column("x").combine_chunks().flatten(), np.int64).reshape(-1, dim)
    col = lambda name: t.column(name).to_numpy().astype(np.int64).tobytes()
    one = [dim, t.column("pack")[0].as_py(), col("row"), col("vec_id"), col("label"), *_put(x), wide, edges[0].tobytes(), edges[1].tobytes()]
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array([v], k) for v, k in zip(one, kinds)], [c.split()[0] for c in PACK.split(", ")])


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest inner product of each anchor with any vector between ``low`` and ``high``, by interval
    arithmetic in doubles, rounded outwards."""
    a, low, high = a.astype(np.float64), low.astype(np.float64), high.astype(np.float64)
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    sizes = np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T
    slack = np.where(sizes < 2.0**52, 0.0, sizes * 1e-13 * a.shape[1])  # whole numbers are exact below
    return least - slack, most + slack


def chosen(r: dict, same: bool, probe: bool) -> np.ndarray:
    """Which (anchor, block) pairs of a pack of anchors and a pack of zone maps are to be read."""
    dim, wide = r["dim"], r["windows"]
    a = _get(r["vectors"], r["width"], dim)
    i64 = lambda name: np.frombuffer(r[name], np.int64)
    least, most = bounds(a, i64("low").reshape(-1, dim), i64("high").reshape(-1, dim))
    labels, first, last = i64("labels")[:, None], i64("label_lo"), i64("label_hi")
    fits = (first <= labels) & (labels <= last) if same else (first != labels) | (last != labels)
    lo, hi = i64("lo").reshape(-1, wide), i64("hi").reshape(-1, wide)
    out, probed = np.zeros(fits.shape, bool), np.zeros(fits.shape, bool)
    who = np.arange(len(a))
    floors = i64("floors").reshape(-1, wide) if not probe else lo
    for w in range(wide):
        meets = fits & (most >= lo[:, w : w + 1]) & (least <= hi[:, w : w + 1]) & (lo[:, w : w + 1] <= hi[:, w : w + 1])
        best = np.where(meets, most, -np.inf).argmax(axis=1)
        probed[who, best] |= meets[who, best]
        out |= meets & (most >= floors[:, w : w + 1])
    return probed if probe else out & ~probed


NEED = "dim int, segment long, salt long, rows binary, ids binary, labels binary, vectors binary, width int, windows int, lo binary, hi binary, of binary"


def _needs(same: bool, probe: bool):
    """For each pair of packs: the anchors that need a block of a segment, with a bit for each block."""
    names = [c.split()[0] for c in NEED.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.int32(), pa.int32(), *[pa.binary()] * 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {name: b.column(j)[i].as_py() for j, name in enumerate(b.schema.names)}
                picked, blocks = chosen(r, same, probe), np.frombuffer(r["blocks"], np.int64)
                dim, wide = r["dim"], r["windows"]
                i64 = lambda name: np.frombuffer(r[name], np.int64)
                lo = i64("lo" if probe else "floors").reshape(-1, wide)
                for segment in np.unique(blocks // SEGMENT_BLOCKS).tolist():
                    here = np.flatnonzero(blocks // SEGMENT_BLOCKS == segment)
                    bits = (picked[:, here] << (blocks[here] % SEGMENT_BLOCKS)).sum(axis=1)
                    at = np.flatnonzero(bits)
                    if not len(at):
                        continue
                    # what lies under the floor cannot count
                    edges = lo[at], i64("hi").reshape(-1, wide)[at]
                    one = [dim, segment, r["pack"] // SALT_PACKS, i64("rows")[at].tobytes(), i64("ids")[at].tobytes(), i64("labels")[at].tobytes()]
                    one += [*_put(_get(r["vectors"], r["width"], dim)[at]), wide, edges[0].tobytes(), edges[1].tobytes(), bits[at].astype(np.int64).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one, kinds)], names)

    return run


# ------------------------------------------------------------------ reading blocks

FOUND = "dim int, row long, window int, vec_id long, score long"


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as longs."""
    if int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ x.astype(np.int64).T


def _read(k: int, same: bool):
    """The ``k`` best of each window in a segment's blocks that its anchor needs."""

    def best(score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the k best in each row (ids rise along it), and whether they hold something (LEAST: nothing)."""
        score, who = score.copy(), np.arange(len(score))
        out = np.zeros((len(score), min(k, score.shape[1])), np.int64)
        fine = np.zeros(out.shape, bool)
        for j in range(out.shape[1]):
            at = score.argmax(axis=1)
            out[:, j], fine[:, j] = at, score[who, at] != LEAST
            score[who, at] = LEAST
            if not fine[:, j].any():
                break
        return out, fine

    def run(key: tuple, blocks: pa.Table, needs: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        dim = key[0].as_py()
        stored = blocks.select(["block", "ids", "labels", "vectors", "width"]).to_pylist()
        for r in needs.to_pylist() if stored else []:
            a, wide = _get(r["vectors"], r["width"], dim), r["windows"]
            i64 = lambda name: np.frombuffer(r[name], np.int64)
            lo, hi, of = i64("lo").reshape(-1, wide), i64("hi").reshape(-1, wide), i64("of")
            parts: list[list] = [[] for _ in range(wide)]
            for b in stored:
                at = np.flatnonzero(of >> b["block"] % SEGMENT_BLOCKS & 1)
                if not len(at):
                    continue
                ids, labels = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["labels"], np.int64)
                score = _products(a[at], _get(b["vectors"], b["width"], dim))
                fits = (labels == i64("labels")[at][:, None]) == same
                fits &= ids != i64("ids")[at][:, None]
                score = np.where(fits, score, LEAST)
                for w in range(wide):
                    in_ = np.where((score >= lo[at, w][:, None]) & (score <= hi[at, w][:, None]), score, LEAST)
                    place, fine = best(in_, ids)
                    who, j = np.nonzero(fine)
                    parts[w].append((at[who], ids[place[who, j]], score[who, place[who, j]]))
            for w, found in enumerate(parts):
                if not found:
                    continue
                who, ids, score = (np.concatenate(c) for c in zip(*found))
                order = np.lexsort((ids, -score, who))
                who, ids, score = who[order], ids[order], score[order]
                nth = np.arange(len(who)) - np.searchsorted(who, who)
                keep = nth < k
                for o, v in zip(out, (i64("rows")[who[keep]], np.full(keep.sum(), w), ids[keep], score[keep])):
                    o.append(v)
        cols = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
        return pa.table({"dim": pa.array(np.full(len(cols[0]), dim), pa.int32()), "row": pa.array(cols[0], pa.int64()), "window": pa.array(cols[1], pa.int32()), "vec_id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.int64())})

    return run


def _packed(blocks: Blocks, anchors: DataFrame, count: int) -> DataFrame:
    packs = max(1, math.ceil(count / PACK_ANCHORS))
    dealt = anchors.withColumn("pack", F.pmod(F.xxhash64("dim", "row"), F.lit(packs)))
    return dealt.groupBy("dim", "pack").applyInArrow(_pack, PACK)


def _round(blocks: Blocks, packs: DataFrame, k: int, same: bool, probe: bool) -> DataFrame:
    """The results of a probe or of the finish."""
    # every pack of anchors meets every pack of zone maps, and each of those is a key of its own
    number = cut_lineage(blocks.zones.groupBy("dim").agg(F.max("zone_pack").alias("last")))
    spread = with_small(packs, number, ["dim"], "inner").withColumn("zone_pack", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).drop("last")
    met = spread.join(blocks.zones, ["dim", "zone_pack"])
    need = cut_lineage(met.mapInArrow(_needs(same, probe), NEED))
    where = need.select(*[F.col(c).alias(c) for c in ("dim", "segment", "salt")]).distinct()  # fresh names for Spark
    loaded = blocks.blocks.select("dim", "segment", "block", "ids", "labels", "vectors", "width").join(where, ["dim", "segment"])
    found = loaded.groupBy("dim", "segment", "salt").cogroup(need.groupBy("dim", "segment", "salt")).applyInArrow(_read(k, same), FOUND)
    return cut_lineage(found)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("dim", "row", "window").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(blocks: Blocks, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """``dim, row, window, rank, vec_id, score``: the ``k`` best rows of each window, or all that there are.

    ``anchors``: rows of ``blocks.ordered`` with arrays ``lo`` and ``hi`` (a handful of windows each).
    """
    anchors = cut_lineage(anchors.select("dim", "row", "vec_id", "label", "x", "lo", "hi"))
    packs = cut_lineage(_packed(blocks, anchors, anchors.count()))
    first = _round(blocks, packs.withColumn("floors", F.col("lo")), k, same, probe=True)
    floors = _top(first, k).where(F.col("rank") == k).select("dim", "row", "window", "score")
    floors = floors.withColumn("pack", F.pmod(F.xxhash64("dim", "row"), F.lit(max(1, math.ceil(anchors.count() / PACK_ANCHORS)))))

    def raised(key: tuple, pack: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for r in pack.to_pylist():
            floor, rows = np.frombuffer(r["lo"], np.int64).reshape(-1, r["windows"]).copy(), np.frombuffer(r["rows"], np.int64)
            at, w = np.searchsorted(rows, found.column("row").to_numpy()), found.column("window").to_numpy()
            floor[at, w] = np.maximum(floor[at, w], found.column("score").to_numpy())
            out.append(floor.tobytes())
        return pack.append_column("floors", pa.array(out, pa.binary()))

    raised_packs = packs.groupBy("dim", "pack").cogroup(floors.groupBy("dim", "pack")).applyInArrow(raised, PACK + ", floors binary")
    rest = _round(blocks, raised_packs, k, same, probe=False)
    return _top(first.unionByName(rest), k)


def mine(blocks: Blocks, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor (a row of
    ``blocks.ordered``) and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other
    labels that score from ``low`` to ``high`` per cent of the positive."""
    open_ = anchors.withColumns({"lo": F.array(F.lit(LEAST + 1)), "hi": F.array(F.lit(MOST))})
    good = cut_lineage(search(blocks, open_, positives, same=True).select("dim", "row", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # whole numbers s with low * p <= 100 * s <= high * p
    wide = F.col("positive_score").cast("decimal(24,0)")
    edges = good.withColumns({"lo": F.ceil(wide * low / 100).cast("long"), "hi": F.floor(wide * high / 100).cast("long")})
    windows = edges.groupBy("dim", "row").agg(F.array_sort(F.collect_list(F.struct("rank", "lo", "hi"))).alias("w"))  # at most ``positives``
    asked = anchors.join(windows.select("dim", "row", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi")), ["dim", "row"])
    bad = search(blocks, asked, negatives, same=False).select("dim", "row", (F.col("window") + 1).alias("nth"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = good.withColumnRenamed("rank", "nth").join(anchors.select("dim", "row", F.col("vec_id").alias("anchor_id")), ["dim", "row"])
    return named.join(bad, ["dim", "row", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", whole(F.col("embedding"), 256).alias("x"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    blocks = Blocks(rows.withColumn("label", label))
    return mine(blocks, blocks.ordered.where("vec_id % 50 = 0"))
