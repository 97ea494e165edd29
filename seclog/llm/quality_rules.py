"""Quality rules with risk-controlled thresholds.

Each rule is a number per text that grows as the text gets worse. The cutoffs form one fixed sequence (``SEQUENCE``): from
a vector of cutoffs to the next, one rule gets one cutoff stricter, and a text is rejected if any of its values is over.
On the labelled holdout the number of good texts that a vector would reject is a binomial count. For each stratum the
vectors are tested in order: one is certified if the exact binomial tail ``P(X <= rejected | n, risk)`` is at most ``delta``
divided by the number of strata (Bonferroni), and the test stops at the first failure, which needs no further
correction. With probability ``1 - delta`` no stratum loses more than ``risk`` of its good texts, all rules together. A
stratum needs ``ln(delta / strata) / ln(1 - risk)`` good texts at least (144 at four strata), else only the base rules decide.

Only rows with a good label that the base rules pass enter the counts; the cutoffs do not depend on the data. Equal texts of a
stratum count once, since copies are no independent trials. Strata are the values of a column (null is a stratum of its own).
A null text has no words and counts as empty. A document with several labels is good if any of them is 1; null labels count as
none. Repeated rows are judged alike. No labels, or an empty table: only the base rules decide. Other columns are kept whatever
their names.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint_dir, cut_lineage, fresh, table, text_batches, utf8, with_small

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
RISK, DELTA = 0.03, 0.05

#: Rules (expressions over the base counts, worse is larger) and their cutoffs, loosest first: a text is
#: rejected if the value is over the cutoff.
RULES = {
    "symbols_per_word": ("n_symbols / n_words", [2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05]),
    "dup_lines_per_100_words": ("100 * n_dup_lines / n_words", [20.0, 12.0, 8.0, 6.0, 4.0, 3.0, 2.0, 1.0]),
    "repeat_share": ("n_repeat_words / n_words", [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2]),
    "marked_words": ("n_marked / n_words", [0.9, 0.7, 0.5, 0.35, 0.25, 0.15]),
}

#: The order in which rules become strict, each through all its cutoffs before the next begins.
ORDER = ["symbols_per_word", "marked_words", "dup_lines_per_100_words", "repeat_share"]
#: (rule, cutoff) by step; the vector of a step has the last cutoff of each rule so far.
SEQUENCE = [(list(RULES).index(name), cut) for name in ORDER for cut in RULES[name][1]]

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marked"]
MEASURES = T.StructType([T.StructField(f, T.LongType()) for f in FEATURES])
_MARKED = re.compile(rb"[!?#*$%&|<>]{2}(?=[\x20\x09-\x0D]|\Z)")


def measures(data: bytes) -> tuple[int, ...]:
    """The counts of FEATURES for a text's UTF-8 bytes. ``n_marked``: words that end in two marks of ``!?#*$%&|<>``."""
    words = data.split()
    n = len(words)
    chars = sum(map(len, words)) - sum(map(data.count, CONTINUATION)) if not data.isascii() else sum(map(len, words))
    symbols = sum(data.count(c) for c in _SYMBOL_BYTES)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 3:
        code: dict[bytes, int] = {}
        ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, n)
        m = len(code) + 1
        pairs = ids[:-1] * m + ids[1:]
        _, pairs = np.unique(pairs, return_inverse=True)
        _, at, times = np.unique(pairs[:-1] * m + ids[2:], return_inverse=True, return_counts=True)
        twice = times[at] > 1
        covered = np.zeros(n, bool)
        covered[:-2] |= twice
        covered[1:-1] |= twice
        covered[2:] |= twice
        repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(_MARKED.findall(data))


_SYMBOL_BYTES = [c.encode() for c in SYMBOLS]
CONTINUATION = [bytes([b]) for b in range(0x80, 0xC0)]


def features(text: Column) -> Column:
    """A struct of FEATURES (longs)."""

    @F.arrow_udf(MEASURES)
    def counted(texts: pa.Array) -> pa.Array:
        rows = np.array([measures(t.as_py()) for t in texts], np.int64).reshape(-1, len(FEATURES))
        return pa.StructArray.from_arrays([pa.array(rows[:, i].copy()) for i in range(len(FEATURES))], FEATURES)

    return counted(utf8(text))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def rule_values(f: str) -> list[Column]:
    """The rules' values from a struct column ``f`` of FEATURES (null for a text without words)."""
    out = []
    for expr, _ in RULES.values():
        for name in FEATURES:
            expr = re.sub(rf"\b{name}\b", f"cast(`{f}`.{name} as double)", expr)
        out.append(F.expr(f"case when `{f}`.n_words > 0 then {expr} end"))
    return out


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly."""
    if n <= 0 or k >= n:
        return 1.0
    head = math.lgamma(n + 1)
    return min(1.0, math.fsum(math.exp(head - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)))


@F.pandas_udf(T.DoubleType())
def _tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_tail(int(a), int(b), float(c)) for a, b, c in zip(k, n, p)], dtype="float64")


def vector(step: int) -> list[float | None]:
    """The cutoffs of a step, one for each rule (None: no cutoff yet)."""
    out: list[float | None] = [None] * len(RULES)
    for rule, cut in SEQUENCE[: step + 1]:
        out[rule] = cut
    return out


def certified(good: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``stratum, cutoffs``: an array with each rule's certified cutoff (null: none).

    ``good``: rows of the good holdout, columns ``stratum`` and ``values`` (an array with a value per rule).
    Rows are counted by (stratum, first step that rejects them), which is small whatever the input.
    """
    never = len(SEQUENCE)
    # steps grow stricter, so what a step rejects all later ones do; a null value is never over
    first = F.least(*[F.when(F.col("values")[rule] > cut, step).otherwise(never) for step, (rule, cut) in enumerate(SEQUENCE)])
    counts = cut_lineage(good.groupBy("stratum", first.alias("first")).agg(F.count("*").alias("n")))
    level = delta / max(1, counts.select("stratum").distinct().count())
    tried = counts.select("stratum", "first", "n", F.explode(F.sequence(F.lit(0), F.lit(never - 1))).alias("step"))
    tried = tried.groupBy("stratum", "step").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("first") <= F.col("step"), F.col("n")).otherwise(0)).alias("k"))
    # a count far over its mean cannot be certified, so its tail needs no summing
    mean = F.col("n") * risk
    tried = tried.withColumn("p", _tail(F.when(F.col("k") <= mean, F.col("k")).otherwise(F.col("n")), F.col("n"), F.lit(risk)))
    failed = F.max((F.col("p") > level).cast("int")).over(W.partitionBy("stratum").orderBy("step"))
    best = tried.withColumn("failed", failed).where("failed = 0").groupBy("stratum").agg(F.max("step").alias("step"))
    vectors = F.array(*[F.array(*[F.lit(c).cast("double") for c in vector(step)]) for step in range(never)])
    return cut_lineage(best.select("stratum", vectors[F.col("step")].alias("cutoffs")))


def labelled_good(measured: DataFrame, labels: DataFrame, f: str, digest: str, doc_id: str, stratum: str) -> DataFrame:
    """The good rows of the holdout, equal texts of a stratum once: ``stratum, values``."""
    good = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("__q")).where("__q = 1")
    held = measured.join(good, F.col(f"`{doc_id}`") == F.col("__id"), "left_semi")
    held = held.where(~base_failed(F.col(f"`{f}`.n_words"), F.col(f"`{f}`.n_repeat_words")))  # what the base rejects is not the method's
    return held.select(F.struct(F.col(f"`{stratum}`").alias("of")).alias("stratum"), F.col(f"`{digest}`").alias("digest"), F.array(*rule_values(f)).alias("values")).distinct()


def judged(measured: DataFrame, cutoffs: DataFrame, f: str, stratum: str, kept: str) -> DataFrame:
    """``measured`` and a boolean ``kept``."""
    cut, of = fresh(measured, "cutoffs"), fresh(measured, "stratum")
    small = cutoffs.select(F.col("stratum").alias(of), F.col("cutoffs").alias(cut))
    joined = with_small(measured.withColumn(of, F.struct(F.col(f"`{stratum}`").alias("of"))), small, [of], "left")
    over = [F.coalesce(v > F.col(cut)[i], F.lit(False)) for i, v in enumerate(rule_values(f))]
    bad = base_failed(F.col(f"`{f}`.n_words"), F.col(f"`{f}`.n_repeat_words"))
    for x in over:
        bad = bad | x
    return joined.withColumn(kept, ~bad).drop(cut, of)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that the rules keep. The texts are measured once, written with their measures, and not shuffled."""
    spark, f, digest, kept = docs.sparkSession, fresh(docs, "measures"), fresh(docs, "digest"), fresh(docs, "kept")
    text_batches(spark)
    path = f"{checkpoint_dir(spark)}/quality-{uuid.uuid4().hex}"
    docs.withColumns({f: features(F.col(f"`{text}`")), digest: F.md5(utf8(F.col(f"`{text}`")))}).write.parquet(path)
    measured = spark.read.schema(T.StructType([*docs.schema.fields, T.StructField(f, MEASURES), T.StructField(digest, T.StringType())])).parquet(path)
    cutoffs = certified(labelled_good(measured, labels, f, digest, doc_id, stratum), risk, delta)
    return judged(measured, cutoffs, f, stratum, kept).where(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdicts: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept``."""
    text_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = cut_lineage(docs.select("doc_id", "lang", features(F.col("text")).alias("m"), F.md5(utf8(F.col("text"))).alias("digest")))
    cutoffs = certified(labelled_good(measured, table(spark, sf_dir, "labels"), "m", "digest", "doc_id", "lang"))
    out = judged(measured, cutoffs, "m", "lang", "kept")
    failed = base_failed(F.col("m.n_words"), F.col("m.n_repeat_words"))
    return out.select("doc_id", *[F.col(f"m.{c}") for c in FEATURES[:-1]], failed.alias("base_failed"), "kept")


def _sql() -> str:
    values = ", ".join(f"({i}, case when n_words > 0 then ({expr})::double end)" for i, (expr, _) in enumerate(RULES.values()))
    steps = ", ".join(f"({step}, {rule}, {cut}::double)" for step, (rule, cut) in enumerate(SEQUENCE))
    tail = "least(1.0, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))))"
    tail = f"case when n <= 0 or k >= n or k > n * {{p}} then 1.0 else {tail} end".replace("{p}", repr(RISK))
    white = "[^\\x20\\x09-\\x0D]"
    return f"""
with w as materialized (select doc_id, lang, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{white}+') ws, row_number() over () r from documents),
g as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g from w, unnest(range(1, len(ws) - 1)) u(i)),
rep as (select r, count(distinct i + o) n from (select r, i, count(*) over (partition by r, g) c from g), unnest(range(0, 3)) v(o) where c > 1 group by 1),
dup as (select r, sum(c - 1) n from (select r, l, count(*) c from w, unnest(string_split(t, chr(10))) v(l) where regexp_matches(l, '{white}') group by all) group by 1),
m as materialized (select w.doc_id, lang, t, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols, coalesce(dup.n, 0)::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words,
  len(list_filter(ws, lambda x: regexp_matches(x, '[!?#*$%&|<>]{{2}}$')))::bigint n_marked
  from w left join rep on rep.r = w.r left join dup on dup.r = w.r),
j as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words base_failed from m),
v as materialized (select doc_id, lang, t, rule, x from j, (values {values}) q(rule, x) where not base_failed),
q as (select doc_id from labels where quality is not null group by 1 having max(quality) = 1),
steps as (select * from (values {steps}) c(step, rule, cut)),
good as (select lang, t, rule, max(x) x from v join q on q.doc_id = v.doc_id group by all),
firsts as (select lang, t, coalesce(min(step) filter (x > cut), {len(SEQUENCE)}) first from good join steps on steps.rule = good.rule group by all),
t as (select lang, step, count(*) n, count(*) filter (first <= step) k from firsts, (select distinct step from steps) group by all),
p as (select *, {tail} p, count(distinct coalesce(lang, '') || (lang is null)) over () strata from t),
o as (select *, max((p > {DELTA} / strata)::int) over (partition by lang order by step) failed from p),
last as (select lang, max(step) step from o where failed = 0 group by all),
best as (select lang, rule, arg_max(cut, steps.step) cut from last join steps on steps.step <= last.step group by all),
bad as (select j.doc_id, j.lang, bool_or(coalesce(x > cut, false)) bad from j, (values {values}) q(rule, x) left join best on best.rule = q.rule and best.lang is not distinct from j.lang group by all)
select j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not bad kept
from j join bad on bad.doc_id = j.doc_id
"""


SQL = _sql()
