import hashlib
import math

import numpy as np
import pytest

from quarry.llm.ptolemy_kmeans import (PtolemyKMeans, choose_pivots, cluster_vectors, lower_bounds, nearest, pivot_pairs,
                                       squared)
from tests.llm.conftest import SMALL, bag

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=8, rounds=10, size=64):
    """Plain Python integers."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
            out.append((min(d), d.index(min(d))))
        return out

    for _ in range(rounds):
        own = assign()
        for j in range(len(centres)):
            members = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == j]
            if members:
                centres[j] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    own = assign()
    inertia = [sum(d for d, c in own if c == j) for j in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return bag((i, c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (d, c) in zip(kept, own, strict=True))


def found(df, **kw):
    return bag(tuple(r) for r in cluster_vectors(df, **kw).collect())


@pytest.fixture(scope="module")
def vectors(spark):
    base = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").limit(150).collect()
    some = list(base[0]["embedding"])
    odd = [(None, some, 1), (None, None, 1), (9001, None, 1), (9002, [], 1), (9003, some[:63], 1), (9004, some + [0.0], 1),
           (9005, [None] + some[1:], 1), (9006, [float("nan")] + some[1:], 1), (9007, [float("inf")] + some[1:], 1),
           (9008, [-float("inf")] + some[1:], 1), (9009, some, None), (9009, some, None), (9009, [0.0] * 64, 2),
           (9010, [-0.0001] * 64, 2), (9011, [1000.0] * 64, 1)]
    return spark.createDataFrame([tuple(r) for r in base] + odd, SCHEMA)


def test_equals_brute_force(vectors):
    assert found(vectors) == brute([(r["vec_id"], r["embedding"]) for r in vectors.collect()])


def test_partitioning_and_extra_columns_change_nothing(vectors):
    from pyspark.sql import functions as F

    extra = vectors.repartition(7).withColumn("v", F.lit("x")).withColumn("cluster", F.lit(1)).withColumn("far", F.lit(2))
    assert found(extra) == found(vectors)


def test_copies_few_rows_and_empty(spark):
    same = [(i, [0.5] * 64, 0) for i in range(20)]
    df = spark.createDataFrame(same, SCHEMA)
    assert found(df) == brute([r[:2] for r in same])
    few = [(1, [0.5] * 64, 0), (2, [0.25] * 64, 0), (2, [0.25] * 64, 0)]
    assert found(spark.createDataFrame(few, SCHEMA)) == brute([r[:2] for r in few])
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, None, 0)], SCHEMA)) == []


def test_too_large_component_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e9] * 64, 0)], SCHEMA)
    with pytest.raises(Exception, match="too large for exact"):
        cluster_vectors(df).collect()


@pytest.mark.parametrize("spread", [3, 1000, 1 << 27])
def test_bounds_never_exceed_the_distance(spread):
    rng = np.random.default_rng(spread)
    v = rng.integers(-spread, spread, (400, 64))
    v[:50] = v[50:100]
    pivots = choose_pivots(v[:64])
    pairs = pivot_pairs(pivots)

    def far(x):
        return np.sqrt(np.stack([squared(x, p) for p in pivots], axis=1).astype(float))

    centres = np.concatenate([v[50:54], v[50:52], rng.integers(-spread, spread, (2, 64))])
    for c, f in zip(centres, far(centres), strict=True):
        exact = squared(v, c)
        bound = lower_bounds(far(v), f, pairs)
        assert all(int(math.floor(b)) <= int(d) for b, d in zip(bound, exact, strict=True))
    cluster, distance, _ = nearest(v, far(v), centres, far(centres), pairs)
    every = np.stack([squared(v, c) for c in centres])
    assert (cluster == every.argmin(axis=0)).all() and (distance == every.min(axis=0)).all()


def test_bounds_save_distances(spark):
    """Separate clusters: most distances are excluded without being computed."""
    rng = np.random.default_rng(5)
    mid = rng.normal(0, 3, (8, 64))
    rows = [(i, (mid[i % 8] + rng.normal(0, 0.05, 64)).tolist(), 0) for i in range(400)]
    model = PtolemyKMeans(spark.createDataFrame(rows, SCHEMA), 8, 3)
    model.fit(3)
    assert model.step() < 0.6 * 8 * 400
