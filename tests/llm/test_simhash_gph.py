import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm.common import connected_components
from quarry.llm.simhash_gph import (allocate, correlated_parts, digest, drop_near_duplicates, fingerprint,
                                    near_duplicates)
from tests.llm.conftest import bag


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(points, distance=2):
    """{point: root} by union-find over all pairs."""
    points = sorted(set(points))
    up = {p: p for p in points}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(points):
        for b in points[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {p: root(p) for p in points}


def brute(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    of = classes(f for _, f in fps)
    first = {}
    for i, f in fps:
        if i is not None:
            first[of[f]] = min(i, first.get(of[f], i))
    return [(i, f"{f:016x}", first.get(of[f])) for i, f in fps]


def test_documents(docs, rows, clash, empty):
    want = bag(brute(rows))
    assert bag(tuple(r) for r in digest(near_duplicates(docs)).collect()) == want
    assert bag(tuple(r) for r in digest(near_duplicates(clash)).collect()) == want
    assert digest(near_duplicates(empty)).count() == 0


def test_spark_hash_is_the_same(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("a b ä"))).first()[0] % 2**64
    assert h == xxhash.xxh64_intdigest("a b ä".encode(), 42) and fingerprint("A B ä") == h


@pytest.mark.parametrize("bucket", [64, 3, 0])
def test_links_equal_all_pairs(spark, monkeypatch, bucket):
    """Clouds of close fingerprints, with and without the midpoint way."""
    from quarry.llm import simhash_gph as S

    rng = random.Random(bucket)
    points = [0, 2**64 - 1]
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12, 40])):
            x = centre
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                x ^= 1 << rng.randrange(64)
            points.append(x)
    points = sorted(set(points))
    signed = [(p - 2**64 if p >> 63 else p,) for p in points]
    df = spark.createDataFrame(signed, "fp long")
    got = {r["node"] % 2**64: r["root"] % 2**64 for r in connected_components(S._links(df, 2, 3, bucket)).collect()}
    want = classes(points)
    size = {}
    for p in points:
        size[want[p]] = size.get(want[p], 0) + 1
    groups, found = {}, {}
    for p in points:
        if size[want[p]] > 1:
            groups.setdefault(want[p], set()).add(p)
            found.setdefault(got.get(p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))
    assert len(got) == sum(map(len, groups.values()))


def test_thresholds_keep_the_pigeonhole_sum():
    rng = np.random.default_rng(1)
    values = rng.integers(-2**63, 2**63 - 1, 500)
    groups = [list(range(0, 22)), list(range(22, 43)), list(range(43, 64))]
    shared = rng.integers(1, 100_000, (500, 3)) * rng.integers(0, 2, (500, 3)) + 1
    t = allocate(shared, values, np.full(64, 0.5), groups, 100_000, 2)
    assert (t.sum(axis=1) == 0).all() and t.min() == -1 and t.max() >= 1


def test_parts_cover_all_bits_and_follow_correlation():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (4000, 64))
    x[:, 40] = x[:, 3]
    x[:, 9] = x[:, 3]
    parts = correlated_parts((x.T @ x).astype(float), len(x))
    assert sorted(b for g in parts for b in g) == list(range(64)) and max(map(len, parts)) == 22
    assert any({3, 9, 40} <= set(g) for g in parts)


def test_components_of_a_long_chain(spark):
    edges = spark.range(400).select((F.col("id") * 7919 % 401).alias("u"), ((F.col("id") + 1) * 7919 % 401).alias("v"))
    got = connected_components(edges).collect()
    assert len(got) == 401 and {r["root"] for r in got} == {0}


def test_one_document_of_each_class_stays(docs, rows, clash):
    n_classes = len(set(classes(plain_fingerprint(t) for _, t in rows).values()))
    heads = {c for _, _, c in brute(rows) if c is not None}
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert len(found) == n_classes and {r["doc_id"] for r in found} >= heads
    assert ("other text under a used id" in {r["text"] for r in found if r["doc_id"] == 905})
    assert drop_near_duplicates(clash).count() == n_classes
