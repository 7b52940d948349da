"""Row positions on shuffled input larger than one partition, and what uses them."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.operators.examples import pad_batches, split_exact
from quarry.operators.inference import bootstrap_ci, contrast_report
from quarry.operators.metrics import accuracy_pivot
from quarry.operators.rows import with_ordinal


def shuffled(spark, n):
    return spark.range(n).select(F.col("id").alias("row_idx"), F.xxhash64("id").alias("x")).repartition(13, "x")


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_positions_after_a_sort(spark, aqe):
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        n = 300_003
        out = with_ordinal(shuffled(spark, n).orderBy("row_idx"), "pos")
        r = out.agg(F.countDistinct("pos"), F.min("pos"), F.max("pos"), F.count_if(F.col("pos") != F.col("row_idx"))).first()
        assert tuple(r) == (n, 0, n - 1, 0)
        assert out.select("pos").where("pos = 77777").count() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_batches_follow_input_order(spark):
    n = 200_000
    ordered = with_ordinal(shuffled(spark, n).orderBy("row_idx").withColumn("input_ids", F.array(F.col("x"))), "pos")
    b = pad_batches(ordered, "input_ids", 16, 0, order="pos")
    assert b.where(F.col("batch_id") != F.floor(F.col("row_idx") / 16)).count() == 0


@pytest.mark.parametrize("ids", [1, 50_000])
def test_split_is_exact_with_hot_and_many_ids(spark, ids, tmp_path):
    n = 200_000
    df = shuffled(spark, n).withColumn("id", F.col("row_idx") % ids)
    out = split_exact(df, "id", 0.05)
    want = math.ceil(0.05 * n)
    assert out.where("split = 'val'").count() == want
    out.write.parquet(f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").where("split = 'val'").count() == want
    assert out.select("split", "x").where("split = 'val'").count() == want


def test_split_of_no_rows(spark):
    df = spark.createDataFrame([], "id long")
    assert split_exact(df, "id", 0.1).columns == ["id", "split"]


def preds(spark, rows):
    return spark.createDataFrame(rows, "run_name string, question_id string, gold_label string, pred_label string, g string")


def test_pivot_with_a_null_category(spark):
    p = preds(spark, [("r", "1", "A", "A", "x"), ("r", "2", "A", "B", None), ("r", "3", "A", "B", "x")])
    assert accuracy_pivot(p, "g", []).first().asDict() == {"run_name": "r", "x": 0.5}


def test_bad_labels_raise(spark):
    with pytest.raises(ValueError, match="outside"):
        bootstrap_ci(preds(spark, [("r", "1", "A", "?", "x"), ("r", "2", "A", "A", "x")]), n_boot=50)


def test_gold_disagreement_raises(spark):
    a, b = "alpha-8b_s1-none_s2-full", "alpha-8b_s1-none_s2-lora"
    models = spark.createDataFrame([("alpha-8b", "m")], "short_name string, model_id string")
    good = [(a, str(i), "AB"[i % 2], "A", "x") for i in range(20)] + [(b, str(i), "AB"[i % 2], "B", "x") for i in range(20)]
    row = contrast_report(preds(spark, good), models, n_boot=50).first()
    assert row["n"] == 20 and row["mcnemar_b"] == 10 and row["mcnemar_c"] == 10
    bad = [(r, q, "C" if r == b else g, p, x) for r, q, g, p, x in good]
    with pytest.raises(ValueError, match="disagree"):
        contrast_report(preds(spark, bad), models, n_boot=50)
