import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.llm.exact_dedup import dedup_groups, drop_copies
from tests.llm.conftest import bag


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x))
        for n, i in enumerate(ids):
            out.append((i, ids[0], len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()))
    return out


def got(df):
    return bag(tuple(r) for r in df.drop("text_hash").collect())


def test_groups(docs, rows, clash):
    want = bag(brute(rows))
    assert got(dedup_groups(docs)) == want
    assert got(dedup_groups(clash)) == want


def test_hash_collisions_are_split_by_bytes(docs, rows):
    weak = dedup_groups(docs, hash_fn=lambda t: F.substring(F.md5(t), 1, 1))
    assert got(weak) == bag(brute(rows))


def test_hot_text_over_partitions(spark):
    df = spark.range(0, 60_000, numPartitions=16).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot  text").otherwise(F.concat(F.lit("t "), F.col("id"))).alias("text"))
    r = dedup_groups(df).agg(F.count(F.lit(1)), F.sum(F.col("kept").cast("int")), F.max("group_size"),
                             F.max(F.when(F.col("group_size") > 1, F.col("keep_id")))).first()
    assert tuple(r) == (60_000, 40_001, 20_000, 0)


def test_drop_copies(docs, rows, empty, clash):
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert bag(r["doc_id"] for r in kept.collect()) == bag(x[0] for x in brute(rows) if x[3])
    assert drop_copies(clash).count() == kept.count()
    assert drop_copies(empty).count() == 0 and dedup_groups(empty).count() == 0
