import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from seclog.llm.lm import KAPPA, LOW_BITS, CountFilter, Tokens, _filled, _level, _pack, _segment, _unpack, scored

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("block", [2000, 1 << 20])
def test_scores_against_exact_counts(spark, sf, block):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(LOWER)) + [" "] for r in docs.collect()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    one = collections.Counter(w for i in train for w in texts[i])
    two = collections.Counter(p for i in train for p in zip([" "] + texts[i][:-1], texts[i]))
    total, kinds = sum(one.values()), len(one)
    near = []
    for r in scored(docs, filter_bytes=1 << 20, block_bytes=block).collect():
        t = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id not in train, len(t), sum(w in one for w in t), total)
        assert math.isclose(r.base_score, sum(math.log10((one[w] + 1) / (total + kinds + 1)) for w in t), rel_tol=1e-9)
        want = sum(math.log10((two[h, w] + KAPPA * (one[w] + 1) / (total + kinds + 1)) / (one[h] + KAPPA)) for h, w in zip([" "] + t[:-1], t))
        near.append((r.score - want) / len(t))
    assert abs(np.mean(near)) < 0.02 and np.abs(near).max() < 0.4  # the filter's counts are rounded


def test_packing():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << LOW_BITS, 1000, dtype=np.uint64))
    n = np.arange(1, len(keys) + 1, dtype=np.uint64) ** 3
    a, b = _unpack(_pack(keys, n))
    assert (a == keys).all() and (b == n).all()
    assert _level(np.array([1, 2, 3, 4, 7, 8, 1 << 40])).tolist() == [1, 2, 2, 3, 3, 4, 41]


def test_filter_levels_and_floor():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 62, 4000, dtype=np.uint64)
    n = rng.geometric(0.2, 4000).astype(np.uint64)
    segment = _segment(keys, 4)
    for bits, floor in ((1 << 18, 1), (1 << 12, 4)):
        rows = []
        for s in range(4):
            mine = np.argsort(keys[segment == s] & np.uint64((1 << LOW_BITS) - 1))
            pack = _pack((keys[segment == s] & np.uint64((1 << LOW_BITS) - 1))[mine], n[segment == s][mine])
            t = _filled(bits)(pa.table({"segment": [s], "data": [pack]}))
            rows.append((s, t.column("floor")[0].as_py(), t.column("bits")[0].as_py()))
        f = CountFilter(4, bits, rows)
        got, levels = f(keys), _level(n)
        held = levels >= f.floor[segment]
        assert (got[held] >= np.exp2(levels[held] - 1.0)).all()  # a filter never forgets
        if floor == 1:
            assert (f.floor == 1).all() and np.mean(got == (np.exp2(levels - 1.0) + np.exp2(levels) - 1) / 2) > 0.98
            assert np.mean(f(rng.integers(0, 1 << 62, 4000, dtype=np.uint64)) > 0) < 0.02
        else:
            assert (f.floor > 1).all() and np.unpackbits(f.data).mean() < 0.6


def test_tokens():
    t = Tokens([b"A b\x0ba", b"", b"a"])
    assert t.sizes.tolist() == [4, 1, 2] and [t.kinds[i] for i in t.ids] == [b"a", b"b", b"a", b" ", b" ", b"a", b" "]
    assert [t.kinds[i] for i in t.before] == [b" ", b"a", b"b", b"a", b" ", b" ", b"a"]


def test_a_small_filter_grows_with_its_entries(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    wide = {r.doc_id: r.score / r.n_tokens for r in scored(docs, filter_bytes=8 << 20).collect()}
    small = {r.doc_id: r.score / r.n_tokens for r in scored(docs, filter_bytes=1 << 10).collect()}
    far = np.array([small[i] - wide[i] for i in wide])
    assert abs(far.mean()) < 0.01 and np.abs(far).max() < 0.2  # no count is left out
