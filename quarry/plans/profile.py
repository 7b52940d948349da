"""Registered queries: table profiles and length sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import profile as P
from quarry.sources import files as FS
from quarry.sources import fixtures as X
from quarry.sources.tables import table

LIMIT = 512
# Allowed error of the checks: several standard errors of the distinct estimate, and of a sketch's ranks.
DISTINCT_SLACK, RANK_SLACK = 5 * P.DISTINCT_RSD, 0.005
TOP = 5
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(spark, sf):
    return table(spark, sf, "documents").select(*DOCUMENT_COLUMNS)


def _sketch_check(spark, sf):
    """The sketched profile beside the exact one: is the estimate within its error?"""
    docs = _documents(spark, sf)
    exact = P.column_profile(docs).select("column", "distinct")
    off = F.abs(F.col("distinct_estimate") - F.col("distinct"))
    return P.column_sketch(docs).join(exact, "column").select(
        "position", "column", "rows", "nulls", (off <= DISTINCT_SLACK * F.col("distinct")).alias("estimate_holds"))


def _length_sketches(spark, sf):
    """Sketches of text lengths, stored per source, read back and merged per language; the
    true rank of each quantile is then counted over all lengths."""
    lengths = _documents(spark, sf).where("lang is not null").select("lang", "source", F.length("text").alias("n_tokens"))
    path = FS.scratch_path(spark, "length-sketches")
    P.length_sketch(lengths, LIMIT, ("lang", "source")).write.parquet(path)
    merged = P.merge_length_sketches(spark.read.parquet(path), ("lang",))
    # A few rows per language beside the lengths: AQE measures them before it broadcasts.
    both = lengths.where("n_tokens is not null").join(merged.withColumnRenamed("n", "total"), "lang")
    n, checks = F.col("total"), []
    for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        below, upto = F.count_if(F.col("n_tokens") < F.col(name)) / F.first("total"), F.count_if(F.col("n_tokens") <= F.col(name)) / F.first("total")
        checks.append(((below <= p + RANK_SLACK) & (upto >= p - RANK_SLACK)).alias(f"{name}_holds"))
    return both.groupBy("lang", n.alias("n"), "share_truncated", "max_len").agg(*checks).withColumn(
        "share_truncated", F.round("share_truncated", 9))


QUERIES = {
    "column_profile": lambda spark, sf: P.column_profile(X.mcq_raw(spark, sf)).drop("type"),
    "column_profile_documents": lambda spark, sf: P.column_profile(_documents(spark, sf)).drop("type"),
    "heavy_values": lambda spark, sf: P.heavy_values(X.mcq_raw(spark, sf), TOP),
    "column_sketch": _sketch_check,
    "length_sketches": _length_sketches,
}

_MCQ_COLUMNS = ("question_number", "question", "option_a", "option_b", "option_c", "option_d", "option_e", "answer", "specialty",
                "umbrella_specialty", "level")


def _profile_sql(src: str, columns: tuple) -> str:
    return "\nunion all ".join(f"select {i} as position, '{c}' as \"column\", count(*) as rows, count(*) - count({c}) as nulls, "
                               f"count(distinct {c}) as \"distinct\" from {src}" for i, c in enumerate(columns))


def _heavy_sql(src: str, columns: tuple) -> str:
    return "\nunion all ".join(f"""select * from (select '{c}' as "column", cast(row_number() over (order by count(*) desc, sha256(v)) as integer) as rank,
  v as value, count(*) as n from (select cast({c} as varchar) as v from {src}) where v is not null group by v) where rank <= {TOP}"""
                               for c in columns)


ORACLE = {
    "column_profile": X.with_fixtures(_profile_sql("mcq_raw", _MCQ_COLUMNS), "mcq_raw"),
    "column_profile_documents": _profile_sql("documents", DOCUMENT_COLUMNS),
    "heavy_values": X.with_fixtures(_heavy_sql("mcq_raw", _MCQ_COLUMNS), "mcq_raw"),
    "column_sketch": f"select position, \"column\", rows, nulls, true as estimate_holds from ({_profile_sql('documents', DOCUMENT_COLUMNS)})",
    "length_sketches": f"""select lang, count(*) as n, round(count(*) filter (where length(text) > {LIMIT}) / count(*), 9) as share_truncated,
  max(length(text)) as max_len, true as p50_holds, true as p95_holds, true as p99_holds
from documents where lang is not null and text is not null group by lang""",
}
