"""Exact dedup: 128-bit content hash groups, byte comparison inside groups.

Two texts are equal when they are identical after every run of white space
(space, tab, LF, VT, FF, CR) is replaced by one space. Steps:

1. One pass over the texts writes a narrow table: id, row id, hash, digest.
2. The byte check groups on (hash, text): a group key holds the bytes, so two
   different texts under one hash give two groups. Copies collapse map-side,
   so a text that a third of all rows repeat leaves each task once.
3. Only hashes with more than one text (collisions) are refined: their rows
   also carry the text as a key. Normally there is none and no text is kept.
4. Groups are aggregated on the narrow table and looked up with ``attach``.

Defined cases: a null text counts as empty, and all empty texts are one group.
A null id sorts after all ids. Of rows that agree in id and text, exactly one
is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import attach, keep_rows, materialise, text_or_empty


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def dedup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 hash_fn: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept, text_sha256
    and text_hash (xxhash64 of the text as it is). ``hash_fn`` maps the normalised text to the group hash; any
    function gives the same result, a weak one only costs more comparisons."""
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(text_or_empty(text_col)).alias("_q_t"),
                       F.xxhash64(text_col).alias("text_hash"))
    base = base.withColumn("_q_h", hash_fn(F.col("_q_t")))
    clash = materialise(base.groupBy("_q_h", "_q_t").agg(F.count(F.lit(1)).alias("n"))
                        .groupBy("_q_h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("_q_h"))
    cols = [F.col("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col("text_hash"),
            F.sha2(F.col("_q_t").cast("binary"), 256).alias("text_sha256")]
    if clash.isEmpty():
        narrow = base.select(*cols, F.col("_q_h").cast("binary").alias("gk"))
    else:
        # The exact way for collided hashes: the text itself is the group key.
        marked = base.join(clash.withColumn("_q_c", F.lit(True)), "_q_h", "left")
        gk = F.when(F.col("_q_c"), F.concat(F.lit("t:"), F.col("_q_t")).cast("binary")) \
              .otherwise(F.concat(F.lit("h:").cast("binary"), F.col("_q_h").cast("binary")))
        narrow = marked.select(*cols, gk.alias("gk"))
    narrow = materialise(narrow)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("id"), F.col("rid").alias("rid")))
    groups = narrow.groupBy("gk").agg(first.alias("f"), F.count(F.lit(1)).alias("group_size")).select(
        "gk", F.col("f.id").alias("keep_id"), F.col("f.rid").alias("keep_rid"), "group_size")
    out = attach(narrow, groups, "gk", "group_size", narrow.count())
    return out.select(F.col("doc_id").alias(id_col), "keep_id", "group_size",
                      (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256", "text_hash")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``dedup_groups`` drops, all columns kept."""
    verdict = dedup_groups(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), "text_hash", "kept")
    return keep_rows(docs, verdict, id_col, text_col)
