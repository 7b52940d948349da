"""Shared pieces of the pipeline operators.

* ``materialise``: cut lineage with a Parquet table in the shared folder that
  ``spark.checkpoint.dir`` names (columnar, so later passes read only the
  columns they use); ``clean_scratch`` removes an application's tables.
* ``attach``: look a value up by key when one key may hold a third of all rows.
* ``connected_components``: min-label contraction over an edge table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir

#: A key counts as hot when it holds at least one in HOT_SHARE of all rows, so
#: there are at most HOT_SHARE hot keys: the proven bound of their broadcast.
HOT_SHARE = 1000


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return df.select(*columns) if columns else df


def scratch_path(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/quarry-scratch/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. What is computed
    from the result no longer depends on the plan behind ``df``: row ids drawn
    there are stored, and a lost executor only costs a re-read."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_scratch(spark: SparkSession) -> None:
    """Delete the tables this application materialised. Call it when results
    built on them have been written; DataFrames that still read them break."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(
        f"{checkpoint_dir(spark).rstrip('/')}/quarry-scratch/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def attach(rows: DataFrame, lookup: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left-join ``lookup`` (one row per ``key``, with the number of rows that
    have the key in ``count``) to ``rows``.

    Keys with at least total / HOT_SHARE rows are broadcast: no more than
    HOT_SHARE such keys can exist. The rest join by shuffle; rows already
    matched get no key there, spread over the partitions by a salt, so no task
    receives a hot key.
    """
    values = [c for c in lookup.columns if c != key]
    hot = lookup.where(F.col(count) * HOT_SHARE >= F.lit(max(1, total)))
    cold = lookup.where(F.col(count) * HOT_SHARE < F.lit(max(1, total)))
    hot = hot.select(F.col(key).alias("_q_hk"), F.struct(*values).alias("_q_hot"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_q_hk"), "left")
    out = out.withColumn("_q_salt", F.when(F.col("_q_hot").isNull(), F.lit(0))
                         .otherwise(F.xxhash64(*[F.col(c) for c in rows.columns if c != key]) % 4096 + 4096))
    cold = cold.select(F.col(key).alias("_q_ck"), F.struct(*values).alias("_q_cold"),
                       # zero, but not a literal: the salt must stay a key of the exchange
                       F.pmod(F.col(count), F.lit(1)).cast("long").alias("_q_cs"))
    out = out.join(cold, (F.col(key) == F.col("_q_ck")) & (F.col("_q_salt").cast("long") == F.col("_q_cs")), "left")
    picked = F.coalesce(F.col("_q_hot"), F.col("_q_cold"))
    return out.select(*rows.columns, *[picked[v].alias(v) for v in values])


def keep_rows(docs: DataFrame, verdict: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that a verdict keeps. ``verdict``: one row per row of
    ``docs`` with id, text_hash (xxhash64 of the text) and kept. A row is known
    by id and text hash; of rows equal in both, one stays."""
    pairs = materialise(verdict.groupBy(F.col("id").alias("_q_id"), F.col("text_hash").alias("_q_h")).agg(
        F.max("kept").alias("_q_k"), F.count(F.lit(1)).alias("_q_n")).where("_q_k").drop("_q_k"))
    tagged = docs.withColumn("_q_own", F.xxhash64(text_col))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_q_id")) & (F.col("_q_own") == F.col("_q_h"))
    if pairs.where("_q_n > 1").isEmpty():
        return tagged.join(pairs, same, "left_semi").select(*docs.columns)
    found = tagged.join(pairs, same)
    repeated = found.where("_q_n > 1").dropDuplicates(["_q_id", "_q_h"])
    return found.where("_q_n = 1").unionByName(repeated).select(*docs.columns)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edge table ``(u, v)``; root is the
    smallest node of the component. Links, labels and components stay in
    tables: only row counts reach the driver.

    Each round lets every node hook to its smallest neighbour, flattens the
    hooks by pointer jumping and contracts the edges, which shrinks the edge
    table until none is left.
    """
    cur = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .distinct())
    labels = None
    while not cur.isEmpty():
        star = materialise(cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")))
        while True:
            up = star.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            nxt = materialise(star.join(up, "root", "left").select("node", "root", "_up"))
            if nxt.where("_up is not null").isEmpty():
                break
            star = nxt.select("node", F.coalesce("_up", "root").alias("root"))
        if labels is None:
            labels = star
        else:
            move = star.select(F.col("node").alias("root"), F.col("root").alias("_new"))
            labels = materialise(labels.join(move, "root", "left")
                                 .select("node", F.coalesce("_new", "root").alias("root")).unionByName(star))
        a = star.select(F.col("node").alias("u"), F.col("root").alias("_ru"))
        b = star.select(F.col("node").alias("v"), F.col("root").alias("_rv"))
        moved = cur.join(a, "u", "left").join(b, "v", "left").select(
            F.coalesce("_ru", "u").alias("u"), F.coalesce("_rv", "v").alias("v")).where("u <> v")
        cur = materialise(moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if labels is None:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = labels.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    return labels.unionByName(roots)
