import random
import re

import xxhash
from pyspark.sql import functions as F

from seclog.llm.queries import queries
from seclog.llm.simhash import BUCKET, _levels, components, fingerprint_of, keep_one, links, masks

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_pair_within_the_radius_collides():
    rng = random.Random(3)
    for level in masks(3, 2):
        for _ in range(300):
            flips = rng.sample(range(64), rng.randrange(1, 4))
            diff = sum(1 << b for b in flips)
            # at the second level: under some refinement of each mask of the first under which the pair is equal
            assert any(m & diff == 0 for m in level)
    first, second = masks(3, 2)
    for _ in range(100):
        diff = sum(1 << b for b in rng.sample(range(64), 3))
        for p, m in enumerate(first):
            if m & diff == 0:
                assert any(second[15 * p + v] & diff == 0 for v in range(15))
    assert all(64 - m.bit_count() <= BUCKET.bit_length() - 1 for m in masks(3, _levels(3))[-1])


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    crowd = {base ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(0, 9))) for _ in range(1500)}  # one bucket of a mask over the rest
    crowd |= {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(map(signed, crowd))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = {r.node: r.root for r in components(links(df, 3)).collect()}
    want = classes(fps, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert {x: found.get(x, x) for x in fps} == want


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 2000 + i) for i in range(500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000} | {2000 + i: 1000 for i in range(500)}


def test_fingerprints_of_odd_texts():
    for text in ("", "  \n", "One", "one two", "A b\x0bC\x1cd\x85 é\xa0f", "a b c a b c a b c", "x " * 70_000):
        assert fingerprint_of(text.encode(), 3) == plain_fingerprint(text), text[:20]


def test_query_against_all_pairs(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = classes(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = queries()["op1_simhash"](spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_keep_one(spark):
    df = spark.createDataFrame([(3, "a b c d", "x"), (3, "a b c d", "x"), (2, "a B c d", "y"), (9, "p q r s", "z"), (None, "p q r s", "w"), (None, "u v", None)], "doc_id long, text string, __row string")
    out = sorted(map(tuple, keep_one(df).collect()), key=str)
    assert out == sorted([(2, "a B c d", "y"), (9, "p q r s", "z"), (None, "u v", None)], key=str)
    assert keep_one(df).where(F.col("doc_id") == 3).count() == 0
