import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quarry.llm.histogram_shards import find_splitters, shard_documents, shard_of
from tests.llm.conftest import bag


def check(out, rows, shards, largest_error):
    assert bag((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == bag(
        (i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in rows)
    slots, sums = defaultdict(list), Counter()
    for r in out:
        slots[r["shard"]].append(r["slot"])
        sums[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    mean = sum(sums.values()) / shards
    assert max(abs(sums[s] - mean) for s in range(shards)) <= largest_error
    return sums


def test_documents(docs, rows, clash, empty):
    largest = max(len(t.encode()) + 16 for _, t in rows)
    check(shard_documents(docs, 5).collect(), rows, 5, largest)
    check(shard_documents(clash, 5).collect(), rows, 5, largest)
    assert shard_documents(empty, 5).count() == 0
    assert shard_documents(docs.limit(3), 40).count() == 3


def test_equal_bytes_with_a_hot_text(spark):
    df = spark.range(0, 30_000, numPartitions=8).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot " * 20)).otherwise(F.repeat(F.col("id").cast("string"), 10)).alias("text"))
    rows = [(r[0], r[1]) for r in df.collect()]
    out = shard_documents(df, 40).collect()
    sums = check(out, rows, 40, 200)
    assert max(sums.values()) < 1.01 * min(sums.values())


def test_equal_texts_stay_together_within_tolerance(spark):
    df = spark.range(0, 20_000, numPartitions=8).select(
        F.col("id").alias("doc_id"), F.repeat((F.col("id") % 4000).cast("string"), 5).alias("text"))
    out = shard_documents(df, 8, tolerance=0.02)
    assert out.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_repeated_identical_rows_are_cut(spark):
    df = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    sums = Counter(r["shard"] for r in shard_documents(df, 40).collect())
    assert set(sums.values()) == {100}


def test_splitters_are_ordered(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"),
                                    (F.col("id") % 7 + 1).alias("size"))
    s = find_splitters(keys, 40)
    assert len(s) == 39 and s == sorted(s)
    got = {r[0]: r[1] for r in keys.groupBy(shard_of(s).alias("x")).agg(F.sum("size")).collect()}
    assert max(got.values()) - min(got.values()) <= 14
