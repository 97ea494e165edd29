from pyspark.sql import functions as F

from seclog.llm.common import ranked
from seclog.llm.mixing import MOST, mixed, planned, targets


def filled(sizes, most=3):
    """Water filling, source by source."""
    weight = {s: k % 3 + 1.0 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = rest / (sum(w for s, w in weight.items() if s not in full) or 1)
        over = {s for s in sizes if s not in full and share * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else share * weight[s] for s in sizes}
        full |= over


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, "é": 300, None: 7}, {"a": 0, "b": 0}, {"a": 5}, {"z": 0, "B": 10, "a": 10}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in targets(df).collect()}
        want = filled(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want), sizes


def test_taken_words_come_near_their_targets_and_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.lit("s"), F.col("doc_id") % 3).alias("source"), F.lit(0).alias("row"), F.length("text").cast("long").alias("size"))
    one, two = (sorted(map(tuple, planned(docs).collect())) for _ in range(2))
    assert one == two
    per = planned(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("big"), F.max("copies").alias("most"))
    for r in per.collect():
        assert abs(r.taken - r.target) <= r.big and r.most <= MOST


def test_rank_within_groups(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, i % 5) for i in range(300)], "g string, v int")
    out = ranked(df, "g", [F.col("v")], "r").collect()
    for g in ("a", None):
        mine = sorted((r.r, r.v) for r in out if r.g == g)
        assert [x for x, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)


def test_rows_come_as_often_as_they_are_taken(spark):
    rows = [(i, "w " * (i % 7 + 1), "a" if i < 5 else "b", None) for i in range(60)] + [(3, "w " * 4, "a", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, times string")
    plan = planned(df.select("doc_id", "source", F.xxhash64("doc_id", "text", "source").alias("row"), F.regexp_count("text", F.lit("w")).cast("long").alias("size")))
    want = {(r.doc_id): r.n for r in plan.groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0").collect()}
    got = {r.doc_id: r["count"] for r in mixed(df).groupBy("doc_id").count().collect()}
    assert got == want and mixed(df).columns == df.columns
