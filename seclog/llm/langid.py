"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree of order 3 is learnt: counts of a byte after its last three, two, one
and no bytes. With escape method C, a byte seen n times in a context of N bytes and d distinct ones costs
``-log2(n / (N + d))`` bits there; an unseen byte costs the escape ``-log2(d / (N + d))`` plus its cost in
the next shorter context, and at last 8 bits. The statistics are frozen after learning, so a byte's cost depends on
its last three bytes only and a text's exact code length is a sum of table entries. The language
with the shortest code wins (ties: the smaller name). ``score`` is its share ``1 / sum(2 ** (best - length))``.

Learning reads at most ``train_bytes`` bytes in all, an equal part for each language: that bounds the trees, which
are broadcast. What is read are pieces of texts, at most a 64th of the part long, drawn by a hash of text and offset, so
every language that has bytes is learnt, however long its texts. A null text or one without a letter is ``und`` with
score 0, as is every text if nothing could be learnt. Equal pieces count once in learning; repeated rows get the same prediction.
Other columns are kept whatever their names.

The score compares languages with each other and says nothing about texts of none of them. For these there is an absolute
measure, the bits per byte of the shortest code: :func:`keep_known` rejects a text whose code is longer than the
codes of nearly all held-out texts of the language (``SLACK`` times their 99th percentile).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, fresh, id_fold, table, text_batches, utf8, with_small

TRAIN_BYTES = 8 << 20
#: Bytes of a piece of text at most, and pieces that a language's part holds at least.
PIECE, PIECES = 4096, 64
FOLDS = 5
#: Stands before every text.
PAD = b"\n\n\n"
#: Bytes scored at once; the arrays for them take about a hundred times as much.
BLOCK = 1 << 18
UNKNOWN = "und"
#: Held-out texts of a language that a limit of bits per byte takes at least, and how far over their 99th percentile it lies.
HELD_TEXTS, SLACK = 20, 1.5


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The four-byte windows that end at each byte of each text, as 32-bit numbers, and the texts' lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(PAD + PAD.join(texts), np.uint8).astype(np.uint32)
    all_ = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:] if len(raw) > 3 else np.empty(0, np.uint32)
    inside = np.ones(len(all_), bool)
    for gap in np.cumsum(lengths + len(PAD))[:-1] if len(texts) else []:
        inside[gap - len(PAD) : gap] = False
    return all_[inside], lengths


class Lookup:
    """A hash table from distinct 32-bit keys to their positions, probed for whole arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 4 - 1).bit_length()) if len(keys) else 4
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.zeros(1 << bits, np.uint32), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.at[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.at[slot[won]], self.keys[slot[won]] = left[won], keys[left[won]]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Positions; -1 for keys that are not there."""
        slot = self._slot(keys)
        out = self.at[slot]
        odd = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[odd]
        while len(odd):
            slot = (slot + 1) & self.mask
            out[odd] = self.at[slot]
            more = (out[odd] >= 0) & (self.keys[slot] != keys[odd])
            odd, slot = odd[more], slot[more]
        return out


@dataclass
class Trees:
    """Costs in bits, a column for each language."""

    langs: list[str]
    windows: Lookup  # of four bytes
    window_cost: np.ndarray
    triples: Lookup  # of three bytes: cost of the last after two, and the escape from the three as a context
    triple_cost: np.ndarray
    triple_escape: np.ndarray
    pair_cost: np.ndarray  # of the second byte after the first
    pair_escape: np.ndarray

    def triple(self, keys: np.ndarray) -> np.ndarray:
        """Cost of the last of three bytes."""
        at = self.triples(keys)
        out = self.triple_cost[at]
        new = np.flatnonzero(at < 0)
        out[new] = self.pair_escape[keys[new] >> 8] + self.pair_cost[keys[new] & 0xFFFF]
        return out

    def costs(self, windows: np.ndarray) -> np.ndarray:
        at = self.windows(windows)
        out = self.window_cost[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            keys = windows[new]
            ctx = self.triples(keys >> 8)
            escape = self.triple_escape[ctx]
            escape[ctx < 0] = 0
            out[new] = escape + self.triple(keys & 0xFFFFFF)
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths: a row for each text, a column for each language."""
        windows, sizes = grams(texts)
        out, ends = np.zeros((len(texts), len(self.langs))), np.cumsum(sizes)
        full = np.flatnonzero(sizes)
        if len(full):
            out[full] = np.add.reduceat(self.costs(windows), (ends - sizes)[full], axis=0, dtype=np.float64)
        return out


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, at = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(at, n, len(kinds))


def _order(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For counted byte strings: own cost of each in its context; the contexts and their escape costs."""
    ctx, at = np.unique(keys >> 8, return_inverse=True)
    total = np.bincount(at, n, len(ctx)) + np.bincount(at, minlength=len(ctx))
    return keys, -np.log2(n / total[at]), ctx, -np.log2(np.bincount(at, minlength=len(ctx)) / total)


def _spread(keys: np.ndarray, own: np.ndarray, values: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``other``, with ``values`` at those of the sorted ``keys`` that are among ``own``."""
    other[np.searchsorted(keys, own)] = values
    return other


def grow(counts: pd.DataFrame) -> Trees:
    """Trees from ``lang, gram, n``: counts of four-byte windows."""
    langs = sorted(counts["lang"].unique())
    by = {lang: (g["gram"].to_numpy(np.uint32), g["n"].to_numpy(np.float64)) for lang, g in counts.groupby("lang")}
    orders = {}
    for lang, (g, n) in by.items():
        levels = []
        for width in (32, 24, 16, 8):
            g, n = _summed(g & np.uint32((1 << width) - 1), n)
            levels.append(_order(g, n))
        orders[lang] = levels
    all4 = np.unique(np.concatenate([orders[x][0][0] for x in langs]))
    all3 = np.unique(np.concatenate([k for x in langs for k in (orders[x][1][0], orders[x][0][2])]))
    cols: dict[str, list] = {k: [] for k in ("w", "t", "te", "p", "pe")}
    for lang in langs:
        four, three, two, one = orders[lang]
        single = _spread(np.arange(256), one[0], one[1], np.full(256, one[3][0] + 8.0))
        escape1 = _spread(np.arange(256), two[2], two[3], np.zeros(256))
        pair = _spread(np.arange(65536), two[0], two[1], (escape1[:, None] + single[None, :]).ravel())
        escape2 = _spread(np.arange(65536), three[2], three[3], np.zeros(65536))
        triple = _spread(all3, three[0], three[1], escape2[all3 >> 8] + pair[all3 & 0xFFFF])
        escape3 = _spread(all3, four[2], four[3], np.zeros(len(all3)))
        # the context of every window is among all3; its last three bytes too
        window = _spread(all4, four[0], four[1], escape3[np.searchsorted(all3, all4 >> 8)] + triple[np.searchsorted(all3, all4 & 0xFFFFFF)])
        for k, v in zip(cols, (window, triple, escape3, pair, escape2)):
            cols[k].append(v)
    w, t, te, p, pe = (np.stack(v, axis=1).astype(np.float32) for v in cols.values())
    return Trees(langs, Lookup(all4), w, Lookup(all3.astype(np.uint32)), t, te, p, pe)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = pd.DataFrame({"lang": b.column(0).to_pylist(), "text": b.column(1).to_pylist()})
        for lang, part in texts.groupby("lang"):
            kinds, n = np.unique(grams(part["text"].tolist())[0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(kinds), "gram": kinds.astype(np.int64), "n": n.astype(np.int64)})


def learn(rows: DataFrame, train_bytes: int = TRAIN_BYTES) -> Trees | None:
    """Trees from ``lang, text`` (UTF-8 bytes); None if there are no bytes to learn from."""
    rows = rows.where("lang is not null and octet_length(text) > 0").withColumn("h", F.xxhash64("lang", "text"))
    texts = rows.groupBy("lang", "h").agg(F.max(F.octet_length("text")).alias("bytes"))  # copies once
    have = texts.groupBy("lang").agg(F.sum("bytes").alias("bytes")).withColumn("langs", F.count("*").over(W.partitionBy()))
    part = F.lit(float(train_bytes)) / F.col("langs")
    size = F.greatest(F.lit(1), F.least(F.lit(PIECE), F.floor(part / PIECES))).cast("int")
    have = cut_lineage(have.select("lang", part.alias("part"), size.alias("size"), (part * 0.8 / F.col("bytes")).alias("rate")))
    # a uniform number from the hash; about 0.8 of the part is drawn, and what goes over the part is left out
    near = with_small(rows, have, ["lang"], "inner")
    places = F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / F.col("size")).cast("int"))
    drawn_at = F.filter(places, lambda i: (F.shiftrightunsigned(F.xxhash64("h", i), 11) / F.lit(float(1 << 53))) < F.col("rate"))
    pieces = near.select("lang", "part", "size", "h", "text", F.explode(drawn_at).alias("i"))
    pieces = pieces.select("lang", "part", F.xxhash64("h", "i").alias("h"), F.substring("text", F.col("i") * F.col("size") + 1, F.col("size")).alias("text"))
    pieces = pieces.groupBy("lang", "text").agg(F.min("h").alias("h"), F.max("part").alias("part"))
    upto = F.sum(F.octet_length("text")).over(W.partitionBy("lang").orderBy("h").rowsBetween(W.unboundedPreceding, 0))
    drawn = pieces.withColumn("upto", upto).where(F.col("upto") <= F.col("part")).select("lang", "text")
    counts = drawn.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # at most train_bytes rows
    return grow(found) if len(found) else None


def predict(text: Column, trees: Trees | None, sc, shared=None) -> Column:
    """A struct ``lang, score, bits``: ``bits`` per byte of the shortest code (null where there is none). ``shared``: the trees
    as a broadcast variable, if there is one."""
    shared = shared or sc.broadcast(trees)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())])

    @F.arrow_udf(kind)
    def named(texts: pa.Array) -> pa.Array:
        trees, best, score, bits = shared.value, [], [], []
        rows = [x.as_py() for x in texts]
        at = 0
        while at < len(rows):
            end, size = at, 0
            while end < len(rows) and (end == at or size + len(rows[end]) <= BLOCK):
                size, end = size + len(rows[end]), end + 1
            part = rows[at:end]
            at = end
            lengths = trees.lengths(part) if trees else None
            for i, t in enumerate(part):
                if trees is None or not any(map(str.isalpha, t.decode("utf-8", "ignore"))):
                    best.append(UNKNOWN)
                    score.append(0.0)
                    bits.append(None)
                    continue
                k = int(lengths[i].argmin())
                best.append(trees.langs[k])
                score.append(float(1 / np.exp2(np.maximum(lengths[i][k] - lengths[i], -1000)).sum()))
                bits.append(float(lengths[i][k] / len(t)))
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], ["lang", "score", "bits"])

    return named(utf8(text))


def learn_from(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", train_bytes: int = TRAIN_BYTES) -> Trees | None:
    """Trees learnt from the rows whose fold of ``doc_id`` is not 0."""
    text_batches(docs.sparkSession)
    train = docs.where(id_fold(F.col(f"`{doc_id}`"), FOLDS) != 0)
    return learn(train.select(F.col(f"`{lang}`").alias("lang"), utf8(F.col(f"`{text}`")).alias("text")), train_bytes)


def longest_codes(docs: DataFrame, trees: Trees | None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", shared=None) -> dict[str, float]:
    """The most bits per byte that a text of each learnt language may take, by the held-out texts (fold 0) that are labelled
    so and found to be so. Languages with fewer than ``HELD_TEXTS`` of them have the largest limit of the others (none if all
    have fewer)."""
    if trees is None:
        return {}
    held = docs.where((id_fold(F.col(f"`{doc_id}`"), FOLDS) == 0) & F.col(f"`{lang}`").isNotNull())
    found = held.select(F.col(f"`{lang}`").alias("own"), predict(F.col(f"`{text}`"), trees, docs.sparkSession.sparkContext, shared).alias("g")).where("own = g.lang")
    rows = found.groupBy("own").agg(F.count("*").alias("n"), F.percentile_approx("g.bits", 0.99, 1000).alias("most")).where(F.col("n") >= HELD_TEXTS)
    limits = {r.own: SLACK * r.most for r in rows.collect()}  # one row for each learnt language, as in the trees
    return {x: limits.get(x, max(limits.values())) for x in trees.langs} if limits else {}


def keep_known(docs: DataFrame, langs: list[str] | None = None, least: float = 0.5, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose text is in one of ``langs`` (all learnt ones by default) with at least this score, and
    whose code is not longer than texts of that language have (:func:`longest_codes`)."""
    guess, trees = fresh(docs, "guess"), learn_from(docs, text, lang, doc_id)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(trees)  # once for both passes
    limits = longest_codes(docs, trees, text, lang, doc_id, shared)
    found = docs.withColumn(guess, predict(F.col(f"`{text}`"), trees, sc, shared))
    keep = (F.col(f"{guess}.lang") != UNKNOWN) & (F.col(f"{guess}.score") >= least)
    if limits:
        most = F.create_map(*[F.lit(v) for pair in limits.items() for v in pair])
        keep = keep & F.coalesce(F.col(f"{guess}.bits") <= F.try_element_at(most, F.col(f"{guess}.lang")), F.lit(True))
    if langs is not None:
        keep = keep & F.col(f"{guess}.lang").isin(langs)
    return found.where(keep).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: ``doc_id, held_out, lang_pred, score``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    guess = predict(F.col("text"), learn_from(docs), spark.sparkContext)
    out = docs.select("doc_id", (id_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), guess.alias("guess"))
    return out.select("doc_id", "held_out", F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))
