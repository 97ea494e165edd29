import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seclog.llm.langid import PAD, Lookup, grams, grow, keep_known, learn
from seclog.llm.queries import queries


def plain_length(train, text):
    """Code length by PPM with escape method C, order 3, without exclusion."""
    follow = {}
    for t in train:
        data = PAD + t
        for i in range(len(PAD), len(data)):
            for k in range(4):
                follow.setdefault(data[i - k : i], Counter())[data[i]] += 1
    bits, data = 0.0, PAD + text
    for i in range(len(PAD), len(data)):
        for k in (3, 2, 1, 0, -1):
            if k < 0:
                bits += 8
                break
            seen = follow.get(data[i - k : i])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
    return bits


def test_code_lengths():
    train = {"a": [b"the cat sat on the mat", b"the hat"], "b": [b"der hund und die katze", b"\xc3\xbcber \xc3\xa4"]}
    rows = []
    for lang, texts in train.items():
        keys, n = np.unique(grams(texts)[0], return_counts=True)
        rows.append(pd.DataFrame({"lang": lang, "gram": keys.astype(np.int64), "n": n}))
    trees = grow(pd.concat(rows))
    texts = [b"", b"x", b"the", b"die katze sat \xff\x00 on", b"\xc3\xbc" * 30, b"zzzz zzzz"]
    got = trees.lengths(texts)
    for i, t in enumerate(texts):
        for k, lang in enumerate(trees.langs):
            assert abs(got[i, k] - plain_length(train[lang], t)) < 1e-3, (t, lang)


def test_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 32, 20_000, dtype=np.uint32))
    table = Lookup(keys)
    assert (table(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 1 << 32, 20_000, dtype=np.uint32), keys)
    assert (table(other) == -1).all()


def test_held_out_accuracy(spark):
    out = queries()["op7_langid"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    row = out.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert row.n > 100 and row.a >= 0.97


def test_bounded_learning(spark):
    texts = spark.createDataFrame([("en" if i % 3 else "de", f"text {i} " * 50) for i in range(400)], "lang string, text string").select("lang", F.col("text").cast("binary").alias("text"))
    small = learn(texts, 20_000)
    assert small.langs == ["de", "en"] and len(small.window_cost) <= 20_000
    assert learn(texts.limit(0)) is None


def test_stage_keeps_learnt_languages(spark):
    rows = [(i, "das ist ein haus und der hund " * 3 if i % 2 else "this is a house and the dog " * 3, "de" if i % 2 else "en", "x") for i in range(60)] + [(100, "123 456", "en", "x"), (101, None, "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, guess string")
    out = keep_known(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(range(60))
    assert {r.lang for r in keep_known(docs, ["de"]).collect()} == {"de"}


def test_long_texts_and_copies_are_learnt(spark):
    """A text longer than its language's part, and one with thousands of copies."""
    long = [(x, " ".join(f"{x}{i * i % 9973}" for i in range(20_000))) for x in ("de", "fr")]
    rows = [*long, *[("en", "the same words again " * 60)] * 3000, ("en", "some other words")]
    texts = spark.createDataFrame(rows, "lang string, text string").select("lang", F.col("text").cast("binary").alias("text"))
    trees = learn(texts, 20_000)
    assert trees.langs == ["de", "en", "fr"] and len(trees.window_cost) <= 20_000
    lengths = trees.lengths([b"the same words again", b"some other words", b"de1024 de4096", b"fr1024 fr4096"])
    assert [trees.langs[k] for k in lengths.argmin(axis=1)] == ["en", "en", "de", "fr"]


def test_texts_of_no_learnt_language_go(spark):
    """Gibberish and other languages among the given texts: their codes are longer than those of held-out texts."""
    import random

    rng = random.Random(9)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 300")
    finnish = "minun ystäväni asuu pienessä talossa järven rannalla ja kalastaa joka aamu ennen työhön lähtöä koska hän pitää hiljaisuudesta".split()
    polish = "wczoraj wieczorem poszliśmy nad rzekę żeby zobaczyć zachód słońca i porozmawiać o przyszłości naszych dzieci przy ognisku".split()
    letters = "abcdefghijklmnopqrstuvwxyz"
    odd = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 12))) for _ in range(80)) for _ in range(5)]
    odd += [" ".join(rng.choice(words) for _ in range(80)) for words in (finnish, polish) for _ in range(3)]
    odd += [" ".join("%08x" % rng.getrandbits(32) for _ in range(60)) for _ in range(3)]
    more = spark.createDataFrame([(10**9 + i, t, None, "odd", len(t)) for i, t in enumerate(odd)], docs.schema)
    kept = {r.doc_id for r in keep_known(docs.unionByName(more)).select("doc_id").collect()}
    given = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not any(10**9 + i in kept for i in range(len(odd))), [t[:30] for i, t in enumerate(odd) if 10**9 + i in kept]
    assert len(kept & given) >= 0.999 * len(given)
