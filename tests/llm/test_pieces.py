import hashlib
import random

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seclog.llm.common import Remembered
from seclog.llm.pieces import Encoder, Model, Normaliser, _decoded, _fields, decode, encode, encode_decode, model
from seclog.llm.queries import queries

PATH = public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def one(encoder, text):
    counts, ids, begin, end = encoder([text])
    assert counts.tolist() == [len(ids)]
    return list(zip(ids.tolist(), begin.tolist(), end.tolist()))


def spans(plain, text):
    return [(p.id, p.begin, p.end) for p in plain.encode(text, return_type="proto").pieces]


ALPHABET = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "日本", "😀", "12", "'s", "!", "\x1c", "\x00", "\xa0", "aaaaaaaa", "=", "​", "▁", "\U0001f9ff", "<s>", "<0x0A>", "�", "Word", "▁▁x"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join))
def test_ids_and_spans_as_the_plain_library(encoder, plain, text):
    got = one(encoder, text)
    assert got == spans(plain, text)
    ids = [i for i, _, _ in got]
    assert model(PATH).decode(ids) == plain.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(encoder, plain, text):
    text = text.encode("utf-8", "replace").decode()
    assert one(encoder, text) == spans(plain, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 3, 130, 198, 162, 243, 259, 264, 300, 1233, 28705, 30575]), max_size=12))
def test_any_ids_decode_as_the_plain_library(plain, ids):
    want = plain.decode(ids)
    assert model(PATH).decode(ids) == want
    assert _decoded(PATH, np.array([len(ids)]), np.array(ids, np.int64)) == [want]


def test_long_runs(encoder, plain):
    rng = random.Random(3)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(20_000))
    for text in (noise, "x" * 20_000, " " * 5_000, "日" * 3_000, "the" * 4_000 + " " + noise[:3_000]):
        assert one(encoder, text) == spans(plain, text)


def test_charsmap_normalisation_and_offsets():
    """The public compiled map of the rule nmt_nfkc: characters and offsets as the library has them."""
    theirs = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = dict(_fields(dict(_fields(theirs.serialized_model_proto()))[3]))
    ours = Normaliser(spec[2])
    rng = random.Random(4)
    bits = ["Ａ", "ｶﾞ", "①", "ﬁ", "é", " ", "　", "  ", "x", "한", "가", "\xa0", "ǆ", "\n", "​", "½", "日", "﻿"]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 12)))
        want, at = theirs.normalize(text, with_offsets=True)
        chars, source = ours(text)
        bytes_at = [len(text[:i].encode()) for i in range(len(text) + 1)]
        assert chars.replace("▁", " ") == want.replace("▁", " ") and source == [bytes_at[i] for i in at], text


def test_encoder_with_a_charsmap(tmp_path, plain):
    """The given pieces behind the map of nmt_nfkc: ids and spans through the general path."""
    spec = dict(_fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]
    with open(PATH, "rb") as f:
        data = f.read()

    def wire(number, value):
        size, out = len(value), bytearray([number << 3 | 2])
        while size > 127:
            out.append(size & 127 | 128)
            size >>= 7
        return bytes(out) + bytes([size]) + value

    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as f:
        f.write(b"".join(wire(n, spec if n == 3 else v) for n, v in _fields(data)))
    theirs, ours = sentencepiece.SentencePieceProcessor(model_file=path), Encoder(path)
    assert not ours.model.plain
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["Ａb", "ｶﾞ", "①", "ﬁne", "é", " ", "  ", "the", "한", "\n", "　", "\U0001f9ff"]) for _ in range(rng.randrange(12)))
        got = one(ours, text)
        assert [i for i, _, _ in got] == theirs.encode(text), text
        assert got == spans(theirs, text), text
        assert ours.model.decode([i for i, _, _ in got]) == theirs.decode(theirs.encode(text))


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        Model(b"")


def test_remembered_within_its_bound(plain):
    small = Encoder(PATH)
    small.known.limit = 20_000
    rng, most = random.Random(6), 0
    for _ in range(200):
        text = " ".join(f"w{rng.randrange(10**6)} the" for _ in range(30))
        assert [i for i, _, _ in one(small, text)] == plain.encode(text)
        most = max(most, small.known.held)
    assert most < 10_000 + 60 * 400
    made = []

    def make(texts):
        made.extend(texts)
        return np.array([len(t) for t in texts], np.int64), np.array([len(t) for t in texts for _ in t], np.int64)

    rows = Remembered(make, limit=900)
    for _ in range(3):
        counts, values = rows(["ab", "c", "ab", ""])
        assert counts.tolist() == [2, 1, 2, 0] and values.tolist() == [2, 2, 1, 2, 2]
    assert sorted(made) == ["", "ab", "c"]  # passed on from one generation to the next


def test_columns(spark, plain):
    texts = ["Hello  world", "", None, " ", "é\U0001f9ff b", "word " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = df.select("i", "text", encode(F.col("text"), PATH).alias("p"), encode_decode(F.col("text"), PATH).alias("b"))
    out = out.withColumn("back", decode(F.col("p.id"), PATH)).collect()
    for r in out:
        text = r.text or ""
        assert [tuple(p) for p in r.p] == spans(plain, text) and r.b.pieces == r.p
        assert r.back == r.b.decoded == text
        data = text.encode()
        assert b"".join(data[p.begin : p.end] for p in r.p) == data  # the spans tile the text


def test_query(spark, sf, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries()["op13_sentencepiece"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(plain.decode(ids).encode()).hexdigest()
