"""The corpus pipeline: documents through five operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's documents. All stages but the last
return the columns of documents.

1. quality: texts that the rule ensemble predicts as 0 go;
2. exact: of equal texts the one with the smallest id stays;
3. near: one document of each SimHash class stays;
4. secrets: reported secrets are masked, all documents stay;
5. packing: documents become pieces of sequences of at most 2048 ids.

Empty tables pass through all stages; the operators state what they do with
nulls, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import documents, materialise
from quarry.llm.dp_packing import digest, pack
from quarry.llm.exact_dedup import drop_copies
from quarry.llm.queries import tokenizer_path
from quarry.llm.rule_ensemble import drop_rejected
from quarry.llm.secret_links import redact
from quarry.llm.simhash_gph import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_rejected(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, shingle=3, distance=2)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest(pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1, length=2048))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("secrets", secrets), ("packing", packing)]

#: A fitted model and a packing are not expressed in SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
