"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Features: words (``[^\\x20\\x09-\\x0D]+``) and pairs of neighbours, and the same for the words' shapes (letters
to ``a`` or ``A``, digits to ``0``, runs to one; a pair of shapes also says whether the words are equal), hashed into ``2**BITS`` counts, divided by the root
of their sum; and a bias. FTRL-proximal keeps per-coordinate z and n, so its weights are sparse (L1) and its rates adapt.

Training reads at most ``max_rows`` labelled documents, chosen by a hash of ``doc_id``, dealt over ``SHARDS``
learners whose weights are averaged. Scores are sparse dot products over every whole text. A null or empty text
has the bias alone. A document with several labels has their largest; null labels count as none. Repeated rows
are learnt each time they come. Without labels every score is 0.5.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, id_fold, table, text_batches, utf8

BITS = 18
MAX_ROWS = 16_000
SHARDS = 2
FOLDS = 5
EPOCHS = 8
ALPHA, BETA, L1, L2 = 5.0, 1.0, 0.005, 0.005
CUT = 0.3
#: Distinct words whose hashes a worker remembers; the memory starts anew when it is full.
CACHE_WORDS = 300_000
BIAS = 0

_SHAPE = bytes(0x30 if 0x30 <= b <= 0x39 else 0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


class _Hashes(dict):
    """Hashes of a word and of its shape, in one 64-bit number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        shape = _RUN.sub(rb"\1", word.translate(_SHAPE))
        out = self[word] = zlib.crc32(word) << 32 | zlib.crc32(shape, 1)
        return out


_HASHES = _Hashes()


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


def features(data: bytes) -> tuple[np.ndarray, float]:
    """Feature numbers of a text's UTF-8 bytes, repeats included, and the value of one of them."""
    words = data.split()
    if not words:
        return np.empty(0, np.int64), 0.0
    both = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    again = (both[1:] == both[:-1]).astype(np.uint64) << np.uint64(60)
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    pairs = [h[:-1] * np.uint64(31) ^ (h[1:] << np.uint64(20)) for h in (word, shape)]
    at = np.concatenate([_mixed(word, 1), _mixed(shape, 2), _mixed(pairs[0], 3), _mixed(pairs[1] + again, 4)]).astype(np.int64)
    at[at == BIAS] = BIAS + 1  # one number is the bias's own
    return at, 1 / math.sqrt(len(at))


def vector(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers (the bias first) and their values."""
    at, one = features(data)
    at, n = np.unique(at, return_counts=True)
    return np.concatenate([[BIAS], at]), np.concatenate([[1.0], n * one])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """FTRL-proximal for logistic loss."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == BIAS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def update(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (_sigmoid(w @ value) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["h", "text"])
    data = [(*vector(t), float(y)) for t, y in zip(rows["text"], rows["label"])]
    model = Ftrl()
    for _ in range(EPOCHS):
        for at, value, label in data:
            model.update(at, value, label)
    w = model.weights(np.arange(1 << BITS))
    at = np.flatnonzero(w)
    return pd.DataFrame({"at": at, "w": w[at]})


def train(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> np.ndarray | None:
    """Weights learnt from ``docs`` (``doc_id, text``) and a 0/1 column of ``labels``, outside fold 0."""
    text_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (id_fold(F.col("doc_id"), FOLDS) != 0))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("label"))
    known = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_rows)
    known = cut_lineage(known)  # max_rows narrow rows at most, hence broadcast
    rows = docs.join(F.broadcast(known), "doc_id").select("h", "label", utf8(F.col("text")).alias("text"))
    models = rows.groupBy(F.pmod(F.shiftright("h", 7), F.lit(SHARDS)).alias("shard")).applyInPandas(_fit, "at long, w double")
    # rounded, so that the order of adding does not show
    summed = models.groupBy("at").agg(F.sum(F.round(F.col("w") * 1e9).cast("long")).alias("w")).toPandas()  # 2**BITS rows at most
    if not len(summed):
        return None
    out = np.zeros(1 << BITS)
    out[summed["at"].to_numpy()] = summed["w"].to_numpy() / 1e9 / SHARDS
    return out


def score(text: Column, weights: np.ndarray | None, sc) -> Column:
    """The chance that the label is 1."""
    shared = sc.broadcast(np.zeros(1 << BITS) if weights is None else weights)

    @F.arrow_udf(T.DoubleType())
    def chance(texts: pa.Array) -> pa.Array:
        w = shared.value
        return pa.array([float(_sigmoid(w[BIAS] + w[at].sum() * one)) for at, one in (features(t.as_py()) for t in texts)], pa.float64())

    return chance(utf8(text))


def op10_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score: ``doc_id, held_out, score, predicted``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels"), "quality")
    out = docs.select("doc_id", (id_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), score(F.col("text"), weights, spark.sparkContext).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
