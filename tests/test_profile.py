"""Table profiles against brute force, sketches against their stated errors."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import metrics as M
from quarry.operators import profile as P

# Names that the operators use themselves, and one with a dot.
SCHEMA = "column string, value string, `n.x` long, digest binary, rank double, n boolean"


def sample():
    rows = [(["a", "b", None, "", "long " * 2000][i % 5], f"v{i}", i % 7 if i % 3 else None, bytes([i % 4, 255]), None, i % 2 == 0)
            for i in range(300)]
    return rows + [("hot", "hot", 1, b"", float("nan"), True)] * 200  # a third of all rows and more


def as_text(v):
    if v is None:
        return None
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex().upper()
    if isinstance(v, bool):
        return str(v).lower()
    return "NaN" if v != v else str(v)


def test_profile_is_exact(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {r.column: r for r in P.column_profile(df).collect()}
    best = {}
    for r in P.heavy_values(df, 3).collect():
        best.setdefault(r.column, {})[r["rank"]] = (r.value, r.n)
    for i, name in enumerate(df.columns):
        values = [as_text(r[i]) for r in rows]
        there = Counter(v for v in values if v is not None)
        r = got[name]
        assert (r.position, r.rows, r.nulls, r["distinct"]) == (i, len(rows), values.count(None), len(there))
        want = sorted(there.items(), key=lambda e: (-e[1], hashlib.sha256(e[0].encode()).digest()))[:3]
        assert [best[name][k] for k in sorted(best[name])] == want and sorted(best[name]) == list(range(1, len(want) + 1))
    assert got["digest"].type == "binary" and got["n.x"].type == "bigint"


def test_profile_of_no_rows_and_of_nulls(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert [(r.rows, r.nulls, r["distinct"]) for r in P.column_profile(none).collect()] == [(0, 0, 0)] * 6
    assert P.heavy_values(none).count() == 0
    assert {(r.rows, r.nulls, r.distinct_estimate) for r in P.column_sketch(none).collect()} == {(0, 0, 0)}
    nulls = spark.createDataFrame([(None, None)] * 4, "a string, b long")
    assert [(r.rows, r.nulls, r["distinct"]) for r in P.column_profile(nulls).collect()] == [(4, 4, 0)] * 2
    assert P.heavy_values(nulls).count() == 0
    # One null among rows: still one group of the column.
    one = P.column_profile(spark.createDataFrame([("x",), (None,)], "a string")).first()
    assert (one.rows, one.nulls, one["distinct"]) == (2, 1, 1)


def test_texts_are_not_shuffled(spark):
    df = spark.createDataFrame(sample(), SCHEMA)
    plan = P.heavy_values(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan
    # What is exchanged before the values are fetched: column, digest and count.
    assert "hashpartitioning(column" in plan and "hashpartitioning(value" not in plan


def test_distinct_estimate(spark):
    df = spark.range(400_000).select(F.col("id").alias("unique"), (F.col("id") % 1000).alias("some"), F.lit("x").alias("one"))
    for r in P.column_sketch(df).collect():
        true = {"unique": 400_000, "some": 1000, "one": 1}[r.column]
        assert r.rows == 400_000 and r.nulls == 0 and abs(r.distinct_estimate - true) <= 5 * P.DISTINCT_RSD * true


@pytest.mark.parametrize("slices", [1, 40])
def test_rank_error_of_merged_sketches(spark, slices):
    """A million skewed lengths: the true rank of every quantile is within 0.5% of the one asked for."""
    u = F.rand(7)
    lengths = spark.range(0, 1_000_000, 1, 8).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("corpus"),
                                                     (F.col("id") % slices).alias("slice"), F.floor(20 / (u * u + 0.001)).alias("n_tokens"))
    lengths = lengths.persist()
    try:
        sketches = P.length_sketch(lengths, 512, ("corpus", "slice"))
        assert sketches.count() == (2 if slices == 1 else slices)
        exact = {r.corpus: r for r in M.token_length_profile(lengths, 512).collect()}
        for r in P.merge_length_sketches(sketches).collect():
            e = exact[r.corpus]
            assert (r.n, r.max_len, r.share_truncated) == (e.n, e.max_len, pytest.approx(e.share_truncated))
            mine = lengths.where(F.col("corpus") == r.corpus)
            for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
                below, upto = mine.agg(F.avg((F.col("n_tokens") < r[name]).cast("int")), F.avg((F.col("n_tokens") <= r[name]).cast("int"))).first()
                assert below <= p + 0.005 and upto >= p - 0.005
    finally:
        lengths.unpersist()


def test_length_sketch_of_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("a", 5), ("a", None), (None, 7)], "corpus string, n_tokens int")
    got = {r.corpus: (r.n, r.p50, r.p99, r.max_len, r.share_truncated) for r in P.merge_length_sketches(P.length_sketch(df, 6)).collect()}
    assert got == {"a": (1, 5, 5, 5, 0.0), None: (1, 7, 7, 7, 1.0)}
    assert P.merge_length_sketches(P.length_sketch(df.limit(0), 6)).count() == 0
