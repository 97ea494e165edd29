import hashlib
import random

import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seclog.llm.bpe import Codec, _chunks, decode, encode, encode_decode, read_ranks
from seclog.llm.queries import queries

PATH = public.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return Codec(read_ranks(PATH))


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_each_token_encodes_as_itself(codec):
    """What the seam test of ``join`` rests on."""
    assert all(codec._merge(t) == [i] for t, i in codec.ranks.items())


@settings(max_examples=300, deadline=None)
@given(a=st.binary(max_size=60), b=st.binary(max_size=60), c=st.binary(max_size=60))
def test_join_is_a_monoid_and_encodes(codec, a, b, c):
    one, two, three = codec._merge(a), codec._merge(b), codec._merge(c)
    assert codec.join(one, codec.join(two, three)) == codec.join(codec.join(one, two), three) == codec._merge(a + b + c)
    assert codec.encode(a + b + c) == codec._merge(a + b + c)
    assert codec.decode(codec.encode(a + b)) == a + b


def test_both_merges_agree(codec):
    rng = random.Random(1)
    for _ in range(400):
        data = "".join(rng.choice(["a", "th", "er", "é", "1", " ", "==", "\n"]) for _ in range(rng.randrange(40))).encode()
        assert codec._merge_short(data) == (codec._merge_long(data) if data else [])


def test_texts_as_the_plain_library_encodes_them(spark, plain):
    rng = random.Random(2)
    bits = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "日本", "😀", "12", "'s", "!", "\x1c", "\x85", "\xa0", "aaaaaaaa", "=", "\u200b"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 50, 400]))) for _ in range(600)] + ["0" * 9000, " " * 5000, "ab" * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out = df.select("i", "text", encode(F.col("text"), PATH, public.PATTERN).alias("t")).withColumn("back", decode(F.col("t"), PATH)).collect()
    for r in out:
        assert r.t == plain.encode_ordinary(r.text), r.text[:50]
        assert bytes(r.back) == r.text.encode()


def test_uncut_texts_give_the_same(plain):
    text = "a  b\n\n c'd\n" * 3
    for blanks in (" \n", ""):
        counts, ids = _chunks(PATH, public.PATTERN, blanks)([text, "", text[:5]])
        assert ids.tolist() == plain.encode_ordinary(text) + plain.encode_ordinary(text[:5]) and counts[1] == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=80), st.text("aeth r", max_size=60).map(str.encode)), max_size=12))
def test_all_trees_at_a_time(codec, pieces):
    counts, ids = codec.encode_all(pieces)
    ends = counts.cumsum().tolist()
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts.tolist())] == [codec.encode(p) if p else [] for p in pieces]


def test_encode_and_decode_in_one_pass(spark, plain):
    texts = ["Hello  world", "", None, " ", "é\U0001f9ff b\t", "word " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in df.select("text", encode_decode(F.col("text"), PATH, public.PATTERN).alias("b")).collect():
        assert r.b.tokens == plain.encode_ordinary(r.text or "") and bytes(r.b.decoded) == (r.text or "").encode()


def test_query(spark, sf, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries()["op6_bpe"](spark, sf).collect():
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
