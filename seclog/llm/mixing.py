"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words (``[^\\x20\\x09-\\x0D]+``; a null text has none). Sources, by code
point with null last, weigh 1, 2, 3, 1, 2, 3, ... and share ``total`` (all sizes) by weight. A source takes at most
``most`` times its own size; what that leaves is shared again by weight until no source is above.

Within a source each document is expected ``target / source size`` times. The expectations are summed up in
the order of size (then ``doc_id``), one offset in [0, 1) that a hash of the source fixes is added, and a document is emitted
once for each integer that its interval crosses. In this order the words taken differ from the target by
about one largest document at most, and never more than ``most`` copies of a document are taken. Reruns agree.

A source without words has target 0 and is not taken. Repeated rows are documents of their own. Ties in
size go by ``doc_id`` (null first); which of two rows alike in both comes first does not change the result's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, ranked, table, whole_row_hash, with_small

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def words_in(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``; one row for each source in and out."""
    order = ranked(sizes.withColumn("all", F.lit(0)), "all", [F.col("source").asc_nulls_last()], "nth")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("nth") % len(WEIGHTS)).cast("int") + 1)
    weighed = cut_lineage(order.select("source", "source_size", weight.cast("double").alias("weight")))
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share, cap = 0.0, most * F.col("source_size")
    while True:  # the share of a unit of weight only grows, so a source that is full stays full
        full = F.lit(share) * F.col("weight") > cap
        spent, open_ = weighed.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        new = (total - (spent or 0)) / open_ if open_ else share
        if new <= share:
            break
        share = new
    return weighed.select("source", "source_size", F.least(cap.cast("double"), F.lit(share) * F.col("weight")).alias("target"))


def planned(docs: DataFrame, most: int = MOST) -> DataFrame:
    """``doc_id, source, row, size, source_size, target, copies`` from ``doc_id, source, row, size``."""
    docs = cut_lineage(docs.select("doc_id", "source", "row", "size"))
    goal = cut_lineage(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), most))
    goal = goal.select(F.struct("source").alias("of"), "source_size", "target")  # a struct is never null: null sources join
    placed = ranked(docs, "source", [F.col("size").asc(), F.col("doc_id").asc_nulls_first()], "nth").withColumn("of", F.struct("source"))
    placed = with_small(placed, goal, ["of"], "inner")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = F.concat(F.lit(SEED), F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("|"), F.col("source"))))
    offset = F.conv(F.substring(F.md5(named.cast("binary")), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    # 20 bits of offset: the sums stay exact where the expectation is whole
    upto = lambda i: F.floor(each * i.cast("double") + offset)
    copies = F.least(upto(F.col("nth") + 1) - upto(F.col("nth")), F.lit(most)).cast("long")
    return placed.select("doc_id", "source", "row", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", most: int = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Repeated rows are merged in the tasks that read them, and what
    is left of the texts is shuffled once, to meet their copies."""
    row, times = fresh(docs, "row"), fresh(docs, "times")
    marked = docs.withColumn(row, whole_row_hash(docs))
    plan = planned(marked.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(row).alias("row"), words_in(F.col(f"`{text}`")).alias("size")), most)
    # rows alike in every column are one row with the sum of their copies
    taken = plan.groupBy(F.col("row").alias(row)).agg(F.sum("copies").alias(times)).where(F.col(times) > 0)
    met = marked.dropDuplicates([row]).join(taken, row)
    return met.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: ``doc_id, size, source_size, target, taken``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(0).alias("row"), words_in(F.col("text")).alias("size"))
    return planned(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _shares(rounds: int) -> str:
    step = """, s{i} as (select case when w > 0 then greatest(share, (total - spent) / w) else share end share, total from (
  select s.share, s.total, coalesce(sum(case when s.share * g.weight > 3 * g.source_size then 3 * g.source_size end), 0)::double spent,
    coalesce(sum(case when s.share * g.weight > 3 * g.source_size then null else g.weight end), 0) w
  from g right join s{j} s on true group by all))"""
    return "".join(step.format(i=i, j=i - 1) for i in range(1, rounds + 1))


#: Rounds of resharing that the SQL form spells out; each fills a source or is the last.
SQL_ROUNDS = 24

SQL = f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint size from documents),
g as (select source, source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double weight
  from (select source, sum(size)::bigint source_size from d group by source)),
s0 as (select 0::double share, coalesce(sum(source_size), 0)::double total from g){_shares(SQL_ROUNDS)},
t as (select g.*, least(3.0::double * source_size, share * weight) target from g, s{SQL_ROUNDS}),
p as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end e,
  row_number() over (partition by d.source order by d.size, d.doc_id nulls first) - 1 nth,
  ('0x' || substr(md5('{SEED}' || case when d.source is null then '' else '|' || d.source end), 1, 5))::bigint / {float(1 << 20)}::double u
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (least(floor(e * (nth + 1) + u) - floor(e * nth + u), 3)::bigint * size)::bigint taken from p
"""
