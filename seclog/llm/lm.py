"""Language-model scores from a log-frequency Bloom filter.

Tokens: words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased), then one end token, which also stands before the
first word. Unigrams and bigrams of the training texts are counted over the whole corpus. A count c is quantised to
level ``1 + floor(log2 c)``; the filter holds the n-gram once for each level up to its own, and a query probes
level after level until one is missing. The estimate is the middle of the last level's range.

The filter is cut into segments by the n-gram's hash and grows with the counted n-grams: a segment has
``ENTRY_BITS`` bits for each of its entries, so no count is left out at any size of the corpus. It is never in one place: each
segment's task holds its own part and answers each block of documents for the block's n-grams. An n-gram without a count
counts 0, but for about one in 200 that the filter takes for seen.

``P(w | h) = (c(h, w) + KAPPA * P(w)) / (c(h) + KAPPA)`` and ``P(w) = (c(w) + 1) / (N + V + 1)``, all c from the
filter, ``c(h, w)`` at most ``c(h)``. The base score has exact counts of single tokens: each block of documents asks
the segments for the counts of its own tokens, so no vocabulary is ever in one place. Segments are as many as blocks, so that
a segment has about a block's share. Blocks are cut as the texts are scanned; all that is shuffled is packed and
compressed, and texts are shuffled once, to meet their counts.

A null or empty text has the end token alone. Repeated rows count and are scored each time. Without training
texts N and V are 0 and every probability is 1 in the unigram model.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, id_fold, table, text_batches, utf8

FOLDS, HELD_OUT = 7, 2
#: Bytes of text that are counted and scored together.
BLOCK_BYTES = 8 << 20
#: Bytes of the whole filter at least, however few the entries.
FILTER_BYTES = 16 << 20
HASHES = 3
#: Bits of the filter for each entry at least: a missing one is then found once in 200 times.
ENTRY_BITS = 16
KAPPA = 8.0
#: No word holds a blank, so this is none.
END = b" "
#: Bits of an n-gram's hash below its segment. A segment has the n-grams of about a block at any size of the corpus, so a
#: handful of them fall together.
LOW_BITS = 34
KEY_BYTES = (LOW_BITS + 7) // 8
_LOW = np.uint64((1 << LOW_BITS) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokens:
    """The tokens of some texts: ids in the order of first use, where each text ends, and distinct tokens."""

    def __init__(self, texts: list[bytes]):
        import xxhash

        ids: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        ids[END]
        parts, sizes = [], []
        for t in texts:
            words = t.lower().split()
            words.append(END)
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
            sizes.append(len(words))
        self.ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.ends, self.kinds = np.cumsum(sizes, dtype=np.int64), list(ids)
        self.sizes = np.array(sizes, np.int64)
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, self.kinds), np.uint64, len(self.kinds))
        self.word_keys = _mix(hashed)  # of each distinct token as a unigram
        before = np.r_[np.zeros(1, np.int32), self.ids[:-1]] if len(self.ids) else self.ids
        self.before = before
        self.pair_keys = _mix(hashed[before] * np.uint64(0x9E3779B97F4A7C15) + hashed[self.ids])


    def dealt(self, segments: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The distinct tokens by segment, then as bytes: the segments that occur, the tokens' ids in this order, and
        where a new segment begins."""
        order = np.array(sorted(range(len(self.kinds)), key=self.kinds.__getitem__), np.int64)
        segment = _segment(self.word_keys, segments)[order]
        by = np.argsort(segment, kind="stable")
        order, segment = order[by], segment[by]
        cuts = np.flatnonzero(segment[1:] != segment[:-1]) + 1
        return segment[np.r_[0, cuts]].tolist(), order, cuts

    def grams(self, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the distinct tokens, then of the distinct pairs; their segments; their order by segment and low bits; and
        for each position the number of its pair."""
        pairs, at = np.unique(self.pair_keys, return_inverse=True)
        keys = np.r_[self.word_keys, pairs]
        segment = _segment(keys, segments)
        return keys, segment, np.lexsort((keys & _LOW, segment)), at


# ------------------------------------------------------------------ counting

def _pack(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys below 2**LOW_BITS and their counts, small."""
    import zstandard

    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    return zstandard.compress(np.ascontiguousarray(steps.T).tobytes() + np.ascontiguousarray(n.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = KEY_BYTES + 8
    size = len(raw) // width
    raw = raw.reshape(width, size)
    steps = np.zeros((size, 8), np.uint8)
    steps[:, :KEY_BYTES] = raw[:KEY_BYTES].T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64), np.ascontiguousarray(raw[KEY_BYTES:].T).view("<u8").ravel()


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(LOW_BITS)) % np.uint64(segments)).astype(np.int64)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _pack_numbers(n: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(n.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack_numbers(data: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


COUNTED = "kind int, block long, segment long, data binary, n binary"
#: Kinds of rows, all of a block: its tokens of a segment (joined by line ends) and their counts in training texts; its
#: n-grams of a segment and their counts there (0: in held-out texts alone); its documents.
TOKENS, NGRAMS, DOCUMENTS = 0, 1, 2
_COUNTED = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("segment", pa.int64()), ("data", pa.binary()), ("n", pa.binary())])


def _rows(kind: int, block: int, segment: list[int], data: list[bytes], n: list[bytes] | None = None) -> pa.RecordBatch:
    m = len(data)
    cols = [[kind] * m, [block] * m, segment, data, [None] * m if n is None else n]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _COUNTED)], schema=_COUNTED)


def _packed_table(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _counted_block(t: pa.Table, block: int, segments: int) -> Iterator[pa.RecordBatch]:
    import zstandard

    tokens = Tokens(t.column("text").to_pylist())
    train = np.repeat(~np.array(t.column("held_out").to_pylist(), bool), tokens.sizes)
    words = tokens.ids[train]  # of training texts
    n = np.bincount(words, minlength=len(tokens.kinds))
    yield _rows(DOCUMENTS, block, [0], [_packed_table(t)])
    segment, order, cuts = tokens.dealt(segments)
    parts = [[tokens.kinds[i] for i in at] for at in np.split(order, cuts)]
    yield _rows(TOKENS, block, segment, [zstandard.compress(b"\n".join(p), 9) for p in parts], [_pack_numbers(x) for x in np.split(n[order], cuts)])
    keys, segment, order, at = tokens.grams(segments)
    counts = np.r_[n, np.bincount(at[train], minlength=len(keys) - len(n))].astype(np.uint64)
    keys, counts, segment = (keys & _LOW)[order], counts[order], segment[order]
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    packs = [_pack(k, c) for k, c in zip(np.split(keys, first[1:]), np.split(counts, first[1:]))]
    yield _rows(NGRAMS, block, segment[first].tolist(), packs)


def _counted(segments: int, block_bytes: int):
    """mapInArrow over documents: they are cut into blocks as they come, and each block gives rows of all three kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, left = TaskContext.get().partitionId() << 32, None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                t = pa.Table.from_batches([b])
                left = t if left is None else pa.concat_tables([left, t])
            if left is None or not left.num_rows:
                continue
            ends = np.cumsum(pc.binary_length(left.column("text")).to_numpy())
            start = 0
            while start < len(ends):
                size = ends - (ends[start - 1] if start else 0)
                stop = max(start + 1, int(np.searchsorted(size, block_bytes, side="right")))
                if stop >= len(ends) and b is not None:
                    break  # the next batch may fill this block
                yield from _counted_block(left.slice(start, stop - start), number, segments)
                number, start = number + 1, stop
            left = left.slice(start)

    return run


KNOWN = "block long, segment long, c binary, total long, kinds long"


def _known(t: pa.Table) -> pa.Table:
    """Of a segment: for each block the counts, over all blocks, of its tokens in their order; and the segment's sums."""
    import zstandard

    counts: defaultdict[bytes, int] = defaultdict(int)
    words = [zstandard.decompress(x.as_py()).split(b"\n") for x in t.column("data")]
    for own, n in zip(words, t.column("n")):
        for w, k in zip(own, _unpack_numbers(n.as_py()).tolist()):
            counts[w] += k
    packs = [_pack_numbers(np.fromiter(map(counts.__getitem__, own), np.uint64, len(own))) for own in words]
    m, segment = len(words), t.column("segment")[0].as_py()
    return pa.table({
        "block": pa.array([*t.column("block").to_pylist(), None], pa.int64()), "segment": pa.array([segment] * (m + 1), pa.int64()), "c": pa.array([*packs, None], pa.binary()),
        "total": pa.array([*[None] * m, sum(counts.values())], pa.int64()), "kinds": pa.array([*[None] * m, sum(k > 0 for k in counts.values())], pa.int64()),
    })


# ------------------------------------------------------------------ the filter

def _places(low: np.ndarray, level: int, i: int, bits: int) -> np.ndarray:
    salt = np.uint64((level * HASHES + i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (_mix(low ^ salt) % np.uint64(bits)).astype(np.int64)


def _level(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)  # 1 + floor(log2 n)


def _bits_set(keys: np.ndarray, n: np.ndarray, bits: int) -> tuple[int, bytes]:
    """The lowest level that so many bits hold with half of them free, and the bits."""
    levels, floor = _level(n), 1
    # k bits for each entry set half of the bits if there are ln(2) / k entries a bit
    while HASHES * np.maximum(levels - floor + 1, 0).sum() > bits * math.log(2):
        floor += 1
    out = np.zeros(bits, bool)
    for level in range(floor, int(levels.max(initial=0)) + 1):
        held = keys[levels >= level]
        for i in range(HASHES):
            out[_places(held, level, i, bits)] = True
    return floor, np.packbits(out, bitorder="little").tobytes()


def _filled(bits: int):
    """Of a segment's packed counts: the lowest level that it holds, and its bits."""

    def run(t: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py()) for x in t.column("data")]
        keys, n = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        floor, data = _bits_set(keys, n, bits)
        return pa.table({"segment": pa.array([t.column("segment")[0].as_py()], pa.int64()), "floor": pa.array([floor], pa.int64()), "bits": pa.array([data], pa.binary())})

    return run


class CountFilter:
    """Estimated counts by key."""

    def __init__(self, segments: int, bits: int, rows):
        self.segments, self.bits, self.floor = segments, bits, np.ones(segments, np.int64)
        self.data = np.zeros((segments, bits // 8), np.uint8)
        for segment, floor, data in rows:
            self.floor[segment] = floor
            self.data[segment] = np.frombuffer(data, np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return _estimate(self.levels(keys))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last level found; 0 for none."""
        segment, low = _segment(keys, self.segments), keys & _LOW
        base, flat = segment * (self.bits // 8), self.data.ravel()
        level = self.floor[segment] - 1  # of the last level found
        left = np.arange(len(keys))
        step = 0
        while len(left):
            step += 1
            for at in np.unique(level[left]):  # floors are few
                part = left[level[left] == at]
                for i in range(HASHES):
                    place = _places(low[part], int(at) + 1, i, self.bits)
                    part = part[(flat[base[part] + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1]
                level[part] = -1 - (at + 1)  # found; marked until the round ends
            found = left[level[left] < 0]
            level[found] = -1 - level[found]
            left = found
        return np.where(level < self.floor[segment], 0, level)


def _estimate(level: np.ndarray) -> np.ndarray:
    """The middle of each level's range."""
    return np.where(level == 0, 0.0, (np.exp2(level - 1.0) + np.exp2(level * 1.0) - 1) / 2)


ANSWERED = "block long, segment long, c binary"


def _answered(least: int):
    """Of a segment's packed counts: for each block the levels, found in the segment's filter, of its n-grams in their order."""

    def run(t: pa.Table) -> pa.Table:
        import zstandard

        parts = [_unpack(x.as_py()) for x in t.column("data")]
        sizes = [len(k) for k, _ in parts]
        all_, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        keys, counts = _summed(all_, n)
        held = counts > 0
        entries = int(_level(counts[held]).sum())
        bits = max(least, math.ceil(entries * ENTRY_BITS / 8) * 8)  # enough for level 1, so the floor is 1
        levels = CountFilter(1, bits, [(0, *_bits_set(keys[held], counts[held], bits))]).levels(keys).astype(np.uint8)
        own = np.split(levels[np.searchsorted(keys, all_)], np.cumsum(sizes)[:-1])
        packs = pa.array([zstandard.compress(x.tobytes(), 3) for x in own], pa.binary())
        return pa.table({"block": t.column("block"), "segment": t.column("segment"), "c": packs})

    return run


# ------------------------------------------------------------------ scoring

SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(segments: int, total: int, kinds: int):
    mass = total + kinds + 1

    def run(pack: pa.Table, known: pa.Table) -> pa.Table:
        import zstandard

        docs = pa.ipc.open_stream(pack.column("data")[0].as_py()).read_all()
        tokens = Tokens(docs.column("text").to_pylist())
        # a segment answers for the block's tokens, and for its n-grams, in their order
        packs = sorted(zip(known.column("kind").to_pylist(), known.column("segment").to_pylist(), known.column("c").to_pylist()))
        c = np.empty(len(tokens.kinds))
        c[tokens.dealt(segments)[1]] = np.concatenate([_unpack_numbers(x) for kind, _, x in packs if kind == TOKENS])
        keys, _, order, at = tokens.grams(segments)
        level = np.empty(len(keys), np.uint8)
        level[order] = np.frombuffer(b"".join(zstandard.decompress(x) for kind, _, x in packs if kind == NGRAMS), np.uint8)
        near, pairs = np.split(_estimate(level.astype(np.int64)), [len(tokens.kinds)])
        single = (near + 1) / mass
        context = near[tokens.before]
        both = np.minimum(pairs[at], context)
        chance = np.minimum(1.0, (both + KAPPA * single[tokens.ids]) / (context + KAPPA))
        first = tokens.ends - tokens.sizes
        add = lambda x: np.add.reduceat(x, first)
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(tokens.sizes, pa.int64()),
            "n_known": pa.array(add((c > 0)[tokens.ids].astype(np.int64)), pa.int64()),
            "base_score": pa.array(add(np.log10((c + 1) / mass)[tokens.ids]), pa.float64()), "score": pa.array(add(np.log10(chance)), pa.float64()),
        })

    return run


def scored(docs: DataFrame, filter_bytes: int = FILTER_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of ``doc_id, text``."""
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select("doc_id", utf8(F.col("text")).alias("text"), (id_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    segments = max(64, blocks)
    least = max(64, filter_bytes // segments * 8)
    folder = f"{checkpoint_dir(spark)}/lm-{uuid.uuid4().hex}"

    # the blocks are those that this table has: a task that runs again may cut others, but only one run's rows are in it
    rows.select("doc_id", "text", "held_out").mapInArrow(_counted(segments, block_bytes), COUNTED).write.option("compression", "zstd").parquet(f"{folder}/counted")
    counted = lambda kind: spark.read.schema(COUNTED).parquet(f"{folder}/counted").where(F.col("kind") == kind)
    counted(TOKENS).drop("kind").groupBy("segment").applyInArrow(_known, KNOWN).write.option("compression", "zstd").parquet(f"{folder}/known")
    known = spark.read.schema(KNOWN).parquet(f"{folder}/known")
    total, kinds = known.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()

    levels = counted(NGRAMS).select("block", "segment", "data").groupBy("segment").applyInArrow(_answered(least), ANSWERED)
    answers = known.where("block is not null").select(F.lit(TOKENS).alias("kind"), "block", "segment", "c")
    answers = answers.unionByName(levels.select(F.lit(NGRAMS).alias("kind"), "block", "segment", "c"))
    documents = counted(DOCUMENTS).select("block", "data")
    out = documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(segments, total, kinds), SCORED)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
