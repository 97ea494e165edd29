"""A training-data pipeline over ``documents``: each stage works on all that its predecessor kept.

Quality rules, language ID, SimHash near-duplicates, mixing to target weights, BPE tokens. Each stage takes
``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as Parquet under the shared
folder and reads it again as the next stage's ``docs``. All stages but the last return the columns of ``documents``.

Empty tables give empty results, null texts count as empty (the quality rules reject them), and repeated rows are
judged alike; the near-duplicate stage keeps one of them. Columns beyond those of ``documents`` are kept, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seclog.llm.bpe import encode_decode
from seclog.llm.common import checkpoint_dir, fresh, table, text_batches
from seclog.llm.langid import keep_known
from seclog.llm.mixing import mixed
from seclog.llm.quality_rules import keep_good
from seclog.llm.simhash import keep_one

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the risk-controlled thresholds keep, by the table ``labels``."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is one of those learnt, with a score of 0.5 at least; ``und`` goes."""
    return keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints (3-word shingles) within 3 bits: that of the smallest id."""
    return keep_one(docs, k=3, radius=3)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mix of sources takes it."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding: ``doc_id, lang, source, n_tokens, tokens, round_trip``."""
    import public_tokenizers as public

    path, both = public.path("byte_bpe_50k.tiktoken"), fresh(docs, "both")
    text_batches(spark)
    coded = docs.withColumn(both, encode_decode(F.col("text"), path, public.PATTERN))
    ids, same = F.col(f"{both}.tokens"), F.col(f"{both}.decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_tokens"), ids.alias("tokens"), same.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: SQL cannot express the language model, the fingerprints' components and the tokens; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder, docs = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
