"""Every query of the package and every pipeline stage on empty tables, and on nulls, empty and very long texts, ties,
repeated rows and columns with clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seclog.llm.queries import queries

LONG = "word " * 30_000 + "x" * 20_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, size long, fp long, lang_pred string, __row string"
PARTS = {"en": "the quick brown fox jump over lazy dog near river while bird sing old tall tree", "de": "der schnell braun fuchs spring über faul hund fluss vögel sing hoch baum ungefähr größe"}


def prose(lang, seed, n=80):
    rng = random.Random(f"{lang}{seed}")
    bits = PARTS[lang].split()
    return "\n".join(" ".join(rng.choice(bits) + rng.choice(bits) for _ in range(n // 4)) for _ in range(4))


EXTRA = (1.0, 2, 3, 4, "x", "y")


def rows():
    out = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t", None, "b", 3), (4, LONG, "en", "a", len(LONG)), (5, "one", "de", "é", 3), (5, "one", "de", "é", 3), (6, "12 34 !!", "de", "", 8), (7, "\u00a0 \x85 \x1c 😀 É", "fr", "a", 9)]
    for i in range(10, 90):
        lang = "en" if i % 2 else "de"
        text = prose(lang, i // 4)
        out.append((i, text, lang, f"s{i % 3}", len(text)))
    return [r + EXTRA for r in out]


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("edge"))
    save(spark, d, rows(), [(i, int(i % 7 > 0), 0) for i in range(1, 90)] + [(None, 1, 0), (12, None, None), (12, 1, 0)],
         [(1, None, None), (2, "no scheme", ""), (3, "http://A.Example.NET/en/x?q#f", "<a>é</a>"), (4, "http://a.b.org", "<a>é</a>"), (4, "http://a.b.org", "<a>é</a>"), (None, "x://", "<a>é</a>"), (9, "https://Ünï.org/fr/\n", "h" * 100_000)],
         [(i, [float(i % 5 + 1), 1.0, float(i % 3)]) for i in range(0, 300)] + [(0, [1.0, 1.0, 0.0]), (None, [1.0, 2.0, 3.0]), (400, None), (500, []), (600, [0.0, 0.0, 0.0]), (700, [1.0, None, 2.0]), (800, [float("nan"), 1.0, 1.0]), (900, [float("inf"), 1.0, 1.0]), (1000, [1.0, 2.0])])
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    save(spark, d, [], [], [], [])
    return d


#: Names that the operators use themselves.
CLASHES = {
    "labels": "text lang n stratum values score row __q",
    "pages": "host path rule verdict payload digest record_type row page doc_id text",
    "embeddings": "vector x dim shard block row score rank query_id place component n key zone_pack",
}


def save(spark, d, docs, labels, pages, vectors):
    for name, data, kind in (
        ("documents", docs, DOCS),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("pages", pages, "page_id long, url string, html string"),
        ("embeddings", vectors, "vec_id long, embedding array<float>"),
    ):
        df = spark.createDataFrame(data, kind).coalesce(2)
        if name == "embeddings":
            df = df.withColumn("label", F.expr("if(vec_id < 2000, cast(vec_id % 3 as int), null)"))
        for extra in CLASHES.get(name, "").split():
            df = df.withColumn(extra, F.lit("x"))
        df.write.parquet(f"{d}/{name}.parquet")


PER_ROW = {"op1_simhash": "documents", "op2_warc": "pages", "op4_quality_rules": "documents", "op5_url_filter": "pages", "op6_bpe": "documents", "op7_langid": "documents", "op8_lm": "documents", "op9_mixing": "documents", "op10_classifier": "documents", "op13_sentencepiece": "documents"}


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, empty, name):
    assert queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_for_each_row(spark, edge, name):
    out = queries()[name](spark, edge)
    assert out.count() == spark.read.parquet(f"{edge}/{PER_ROW[name]}.parquet").count()
    if "doc_id" in out.columns:
        assert out.where("doc_id = 5").distinct().count() == 1  # repeated rows are judged alike


def test_defined_results_of_odd_texts(spark, edge):
    q = {n: queries()[n](spark, edge) for n in ("op1_simhash", "op4_quality_rules", "op6_bpe", "op7_langid", "op8_lm", "op9_mixing", "op10_classifier")}
    one = lambda n, i: q[n].where(F.col("doc_id").eqNullSafe(F.lit(i))).first()
    for i in (None, 1, 2, 3):
        assert one("op1_simhash", i).fingerprint == "0" * 16 and one("op1_simhash", i).component_id == 1
        assert tuple(one("op4_quality_rules", i))[1:] == (0, 0, 0, 0, 0, True, False)
        assert one("op7_langid", i).lang_pred == "und" and one("op7_langid", i).score == 0.0
        assert one("op8_lm", i).n_tokens == 1
        assert one("op9_mixing", i).size == 0 and one("op9_mixing", i).taken == 0
    pieces = {r.doc_id: r for r in queries()["op13_sentencepiece"](spark, edge).collect()}
    assert pieces[1].n_tokens == pieces[2].n_tokens == pieces[None].n_tokens == 0 and pieces[4].n_tokens > 30_000
    assert one("op6_bpe", 1).n_tokens == 0 and one("op6_bpe", 1).ids_sha256 == one("op6_bpe", 2).decoded_sha256
    assert one("op7_langid", 6).lang_pred == "und"
    assert len({one("op10_classifier", i).score for i in (None, 1, 2, 3)}) == 1
    assert one("op4_quality_rules", 4).n_words == 30_001


def test_vectors_that_take_no_part(spark, edge):
    out = queries()["op3_ann"](spark, edge).collect()
    assert {r.query_id for r in out} == {0, 100, 200}  # 1000 has another length and meets nobody
    assert {r.vec_id for r in out} <= set(range(300))
    assert all(r.vec_id != r.query_id for r in out)
    for q in (0, 100, 200):
        mine = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        same = [i for i in range(300) if i != q and i % 15 == q % 15]
        assert [r.rank for r in mine] == list(range(1, 11))
        assert [(r.vec_id, r.score) for r in mine] == [(i, 0.0) for i in same[:10]]  # ties: smaller ids


def test_vectors_in_the_new_operators(spark, edge):
    rows = queries()["op11_hard_negatives"](spark, edge)
    assert rows.count() > 0 and rows.where("anchor_id % 50 != 0 or negative_id = anchor_id or 50 * positive_score > 100 * negative_score").count() == 0
    white = queries()["op12_whitening"](spark, edge).groupBy("vec_id").agg(F.count("*").alias("n")).collect()
    # 300 vectors of three dimensions, the repeated id 0, the null id; null, empty, non-finite and lonely ones have none
    assert {r.vec_id for r in white} == {*range(300), 600, None} and {r.vec_id: r.n for r in white}[5] == 3


@pytest.mark.parametrize("at", ["empty", "edge"])
def test_pipeline(spark, request, at):
    d = request.getfixturevalue(at)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toArrow(), out.schema) if at == "edge" else out.limit(0)
    if at == "edge":
        assert docs.count() > 0 and docs.where("not round_trip").count() == 0
