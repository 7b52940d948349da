"""Driver contract, DuckDB oracle parity on a sample of keys, plan shape."""

import math

import pytest

import __spark_entry__ as entry_mod
from tests.conftest import SF001

FAST_KEYS = ["confusion_matrix", "run_metrics", "per_group_metrics", "clean_mcq_with_counters", "clean_mcq",
             "dedupe_run_log", "split_exact", "tokenise_and_mask", "mcnemar", "best_config", "skip_completed",
             "text_hygiene_scan", "perplexity", "argmax_letter"]


def _norm(v):
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 12 and rows[0]["accuracy"] >= rows[-1]["accuracy"]


def test_every_oracle_has_a_query():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.mark.parametrize("key", FAST_KEYS)
def test_oracle_parity(spark, duck, key):
    df = entry_mod.queries()[key](spark, SF001)
    res = duck.execute(entry_mod.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_confusion_kernel_one_shuffle(spark):
    from quarry.operators import metrics as M
    from pyspark.sql import functions as F

    from quarry.sources.tables import table
    p = table(spark, SF001, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 5).cast("string").alias("gold_label"),
        (F.col("o_orderkey") % 5).cast("string").alias("pred_label"),
        F.col("o_orderpriority").alias("run_name"))
    plan = _plan(M.run_metrics(p))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SinglePartition" not in plan


def test_scan_prunes_columns(spark):
    plan = _plan(entry_mod.queries()["perplexity"](spark, SF001))
    assert "ReadSchema: struct<l_orderkey" not in plan or "l_shipdate" not in plan
    assert "l_extendedprice" not in plan


def test_no_single_partition_on_row_level_queries(spark):
    for key in ("clean_mcq", "confusion_matrix", "dedupe_run_log", "tokenise_and_mask", "joint_counts"):
        plan = _plan(entry_mod.queries()[key](spark, SF001))
        assert "SinglePartition" not in plan, key
