"""Indicator extraction, decoding and chunking: golden rows, properties and growth."""

import random
import time

import pytest
from pyspark.sql import functions as F

import golden
from seclog import rules
from seclog.operators.chunking import chunk_text
from seclog.operators.funnel import extract_iocs, extract_whole
from seclog.operators.kb import enhance_query
from seclog.plans.analyze import extract_iocs_job
from seclog.sources.tables import table

LONG = "x" * 3990 + " 192.168.1.1 " + "y" * 200


@pytest.fixture(scope="module")
def edge_df(spark):
    return spark.createDataFrame([(i, g[0]) for i, g in enumerate(golden.EDGE)], "id long, chunk string")


@pytest.mark.parametrize("mode", ["none", "reference"])
def test_edge_rows(spark, edge_df, mode):
    for r in extract_iocs(edge_df, decode=mode, keep_decoded=True).collect():
        text, decoded, plain, after = golden.EDGE[r.id]
        assert [(i.type, i.value) for i in r.iocs] == (after if mode == "reference" and after is not None else plain), r.id
        assert mode == "none" or r.decoded == decoded
        for i in r.iocs:
            assert i.confidence == (0.9 if i.type in ("md5", "sha1", "sha256") else 0.7)
            assert i.context == strip(i.context) and i.value in r.decoded


def test_safe_mode_keeps_hashes(spark, edge_df):
    row = next(r for r in extract_iocs(edge_df, decode="safe").collect() if r.chunk.startswith("hex "))
    assert [i.type for i in row.iocs] == ["md5", "sha1"]


def strip(t):
    return t.replace("\n", " ").strip()


def test_context_is_cut_around_the_match(spark):
    df = spark.createDataFrame([(1, LONG), (2, "a\n1.2.3.4\nb"), (3, "😀" * 100 + " 1.2.3.4 " + "é" * 100)], "id long, chunk string")
    got = {r.id: r.iocs[0].context for r in extract_iocs(df, decode="none").collect()}
    assert got == {1: "x" * 79 + " 192.168.1.1 " + "y" * 79, 2: "a 1.2.3.4 b", 3: "😀" * 79 + " 1.2.3.4 " + "é" * 79}


def test_long_dotted_runs_do_not_overflow(spark):
    df = spark.createDataFrame([(n, "a." * n + " !") for n in (2000, 100_000)] + [(1, "a." * 50_000 + "com-x.b")], "id long, chunk string")
    got = {r.id: [i.value for i in r.iocs] for r in extract_iocs(df, decode="none", types=["domain"]).collect()}
    assert got[2000] == got[100_000] == [] and got[1] == ["a." * 50_000 + "com"]


def one_pass(df):
    """Indicators by one search of each whole text."""
    return {r.log_id: [(i.type, i.value, i.context) for i in r.iocs] for r in extract_iocs(df, text_col="text", decode="none").collect()}


def in_blocks(df):
    got = {}
    for r in extract_whole(df, decode="none").orderBy("log_id", "type_ix", "block_ix", "ioc_ix").collect():
        got.setdefault(r.log_id, []).append((r.type, r.value, r.context))
    return got


def by_hand(text, context=80):
    """The same by Python's re, straight from the rules."""
    import re

    out = []
    for kind, pattern, ignore_case, group in rules.IOC_PATTERNS:
        seen = set()
        for m in re.finditer(pattern, text, re.IGNORECASE if ignore_case else 0):
            value = m.group(group).strip().rstrip(rules.VALUE_RSTRIP_CHARS)
            if value.lower() in seen or (kind == "domain" and value.lower() in rules.FALSE_POSITIVE_DOMAINS):
                continue
            seen.add(value.lower())
            out.append((kind, value, strip(text[max(0, m.start() - context) : m.end() + context])))
    return out


BITS = ["1.2.3.4", "10.0.0.", "evil.com", "google.com", "a.b.", "http://x.io/", "https://", "deadbeef" * 4, "0a" * 20, "ab" * 32, "me@x.org", "@", "User-Agent:", "user-agent: ", "Mozilla/5.0 (X11)", "C:\\w\\a.exe", "/usr/b.sh", "HKLM\\Run", "\\BaseNamedObjects\\m1", "é😀", "z" * 37, "-", ":", ")"]


def random_texts(n, seed, blanks):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) + rng.choice(blanks) for _ in range(rng.choice([5, 60, 400, 1500]))) for _ in range(n)]


def test_whole_texts_are_searched_as_one(spark):
    """Blocks do not show: the same rows as a search of the whole text, with blanks, with few and without."""
    lines = [f"10.{i % 7}.0.{i % 250} evil{i % 90}.com User-Agent: tool/{i % 5} (x)" + "z" * (i % 300) for i in range(400)]
    texts = ["\n".join(lines), " ".join(lines), "", "t" * 9000 + " 1.2.3.4", None]
    texts += random_texts(12, 1, [" ", "\n", "", "\t  "]) + random_texts(12, 2, ["", ",", ";"]) + random_texts(12, 3, [""] * 200 + [" "])
    df = spark.createDataFrame(list(enumerate(texts)), "log_id int, text string")
    got, want = in_blocks(df), one_pass(df)
    for i, text in enumerate(texts):
        assert got.get(i, []) == want[i] == by_hand(text or ""), i
    counts = {r.log_id: r.total_iocs_found for r in extract_iocs_job(df, decode="none").collect()}
    assert counts == {i: len(want[i]) for i in range(len(texts))}


def test_headers_before_any_number_of_blanks(spark):
    """A user-agent header may be followed by any white space, wherever blocks end."""
    texts = []
    for blanks in (0, 1, 50, 300, 600, 3999, 5000):
        for at in (0, 3500, 3900, 3980, 3989, 3995, 4000, 7990):
            for fill in ("w ", "w\n"):
                texts.append((fill * 5000)[:at] + "User-Agent:" + (" \n" * 2500)[:blanks] + "curl/8.0 (linux) " + "tail " * 300)
    df = spark.createDataFrame(list(enumerate(texts)), "log_id int, text string")
    got = in_blocks(df)
    for i, text in enumerate(texts):
        assert got[i] == by_hand(text) and any(t == "user_agent" for t, *_ in got[i]), i


def test_many_matches_in_one_row(spark):
    """Time in proportion to the matches: comma-joined addresses are one run without blanks."""
    took = {}
    for n in (16_000, 50_000, 100_000):
        text = ",".join(f"10.{i // 62500}.{i // 250 % 250}.{i % 250}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "log_id int, text string").cache()
        df.count()
        start = time.time()
        row = extract_iocs(df, text_col="text", decode="none").select(F.size("iocs").alias("n"), F.expr("iocs[size(iocs) - 1]").alias("last")).first()
        took[n] = time.time() - start
        assert row.n == n and row.last.context == text[-80 - len(row.last.value) :]
        start = time.time()
        assert len(in_blocks(df)[1]) == n
        assert extract_iocs_job(df, decode="none").first().total_iocs_found == n
        took[n] = max(took[n], time.time() - start)
    assert took[16_000] < 15 and took[100_000] < 4 * took[50_000]


def test_work_grows_with_the_text_only(spark):
    """16 MB in chunks, and 16,000 indicators in one line, in seconds."""
    big = spark.createDataFrame([(1, "x😀yz\n" * 3_200_000)], "id long, text string").cache()
    many = spark.createDataFrame([(1, " ".join(f"10.{i // 62500}.{i // 250 % 250}.{i % 250}" for i in range(16_000)))], "log_id long, text string").cache()
    assert big.count() == many.count() == 1
    start = time.time()
    assert chunk_text(big, keys=["id"]).count() == 4000
    assert time.time() - start < 5
    start = time.time()
    assert extract_iocs_job(many, decode="none").first().total_iocs_found == 16_000
    assert time.time() - start < 15  # planning included


def test_values_are_substrings_of_decoded_text(spark, edge_df):
    for r in extract_iocs(edge_df, decode="reference", keep_decoded=True).collect():
        for i in r.iocs:
            assert i.value in r.decoded


def test_chunks_reassemble_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ch = chunk_text(docs, keys=["doc_id"], size=4000)
    back = ch.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_ix", "chunk"))), lambda s: s["chunk"]), "").alias("t"))
    bad = back.join(docs, "doc_id").where(F.col("t") != F.col("text")).count()
    assert bad == 0


def test_chunks(spark):
    for text, size, overlap, want in golden.CHUNKS:
        df = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
        assert [(r.chunk_ix, r.chunk) for r in chunk_text(df, keys=["id"], size=size, overlap=overlap).collect()] == list(enumerate(want))


def test_overlap_not_below_size_is_rejected(spark):
    df = spark.createDataFrame([(1, "x")], "id long, text string")
    with pytest.raises(ValueError):
        chunk_text(df, keys=["id"], size=50, overlap=50)


def test_enhanced_queries(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(golden.QUERIES)], "id int, kb_query string")
    assert [r.enhanced_query for r in enhance_query(df).orderBy("id").collect()] == [e for _, e in golden.QUERIES]
