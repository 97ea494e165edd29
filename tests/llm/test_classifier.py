import numpy as np
from pyspark.sql import functions as F

from seclog.llm.classifier import BIAS, Ftrl, features, score, train, vector
from seclog.llm.queries import queries


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    out = queries()["op10_classifier"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    assert len(good) > 300 and len(bad) > 50
    assert np.mean(good[:, None] > bad[None, :]) > 0.99  # area under the curve
    assert (good >= 0.3).mean() > 0.99 and (bad < 0.3).mean() > 0.9
    assert ((out.score >= 0.3).astype(int) == out.predicted).all() and out.score.between(0, 1).all()


def test_learner():
    rng, model = np.random.default_rng(0), Ftrl(64)
    for _ in range(3000):
        at = rng.choice(np.arange(1, 64), 8, replace=False)
        model.update(np.r_[BIAS, at], np.ones(9) / 3, float(3 in at))
    w = model.weights(np.arange(64))
    assert w.argmax() == 3 and (np.abs(w) < 1e-12).sum() >= 0


def test_vectors():
    assert vector(b"")[0].tolist() == [BIAS] and features(b" \n")[1] == 0.0
    at, one = features("Ab, Ab, é9".encode())
    assert len(at) == 10 and abs(one * 10**0.5 - 1) < 1e-12 and (at != BIAS).all()
    ids, value = vector("Ab, Ab, é9".encode())
    assert abs(value[1:].sum() - 10 * one) < 1e-12 and len(ids) == len(set(ids))


def test_scores_repeat_and_need_no_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    one, two = train(docs, labels, "quality"), train(docs.repartition(3), labels.repartition(5), "quality")
    assert (one == two).all()
    assert train(docs, labels.where("doc_id < 0"), "quality") is None
    assert docs.select(score(F.col("text"), None, spark.sparkContext).alias("s")).where("s != 0.5").count() == 0
