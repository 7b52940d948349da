"""Evaluation aggregates: goldens, F1 averaging rules, invariants."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import metrics as M
from quarry.sources import fixtures as X
from tests.conftest import SF001

SCHEMA = "run_name string, question_id long, gold_label string, pred_label string, specialty string"


def _sk_macro_f1(gold, pred, labels=None):
    """Reference arithmetic: F1 per label from tp/fp/fn, mean over labels."""
    labels = labels or sorted(set(gold) | set(pred))
    out = []
    for L in labels:
        tp = sum(g == L and p == L for g, p in zip(gold, pred))
        fp = sum(g != L and p == L for g, p in zip(gold, pred))
        fn = sum(g == L and p != L for g, p in zip(gold, pred))
        out.append(0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn))
    return sum(out) / len(out)


def test_golden_correct_counts(spark):
    acc = {r.run_name: r.n_correct for r in M.accuracy(X.predictions(spark, SF001)).collect()}
    assert acc["alpha-8b_s1-none_s2-full"] == 7739
    assert acc["alpha-8b_s1-none_s2-lora"] == 7442
    assert acc["beta-8b_s1-lora_s2-none"] == 3992
    best = M.best_run(X.predictions(spark, SF001)).first()
    assert best.run_name == "alpha-8b_s1-none_s2-lora_r32"


def test_golden_macro_f1(spark):
    r = M.macro_f1_fixed(X.predictions(spark, SF001)).where("run_name = 'alpha-8b_s1-none_s2-full'").first()
    assert round(r.macro_f1, 6) == 0.515837


def test_confusion_sums_to_n(spark):
    p = X.predictions(spark, SF001)
    cm = M.confusion_matrix(p).groupBy("run_name").agg(F.sum("n").alias("s"), F.count("*").alias("cells"))
    assert {(r.s, r.cells) for r in cm.collect()} == {(15000, 25)}


def test_present_vs_fixed_rule(spark):
    rows = [("r", i, g, p, "s") for i, (g, p) in enumerate([("A", "A"), ("A", "B"), ("B", "B"), ("B", "A"),
                                                            ("A", "A")])]
    df = spark.createDataFrame(rows, SCHEMA)
    gold = [r[2] for r in rows]
    pred = [r[3] for r in rows]
    present = M.macro_f1_present(df).first().macro_f1
    fixed = M.macro_f1_fixed(df).first().macro_f1
    assert present == pytest.approx(_sk_macro_f1(gold, pred))
    assert fixed == pytest.approx(_sk_macro_f1(gold, pred, list("ABCDE")))
    assert fixed == pytest.approx(present * 2 / 5)


def test_rules_agree_when_all_letters_occur(spark):
    m = M.run_metrics(X.predictions(spark, SF001)).collect()
    for r in m:
        assert r.macro_f1 == pytest.approx(r.macro_f1_present)


def test_classwise_zero_division(spark):
    df = spark.createDataFrame([("r", 1, "A", "A", "s"), ("r", 2, "A", "B", "s")], SCHEMA)
    rep = {r.letter: r for r in M.classwise_report(df).collect()}
    assert rep["A"].precision == 1.0 and rep["A"].recall == 0.5 and rep["A"].support == 2
    assert rep["B"].precision == 0.0 and rep["B"].recall == 0.0 and rep["B"].f1 == 0.0
    assert rep["E"].support == 0 and rep["E"].f1 == 0.0


def test_row_normalised_empty_row(spark):
    df = spark.createDataFrame([("r", 1, "A", "A", "s"), ("r", 2, "A", "B", "s")], SCHEMA)
    shares = {(r.gold_label, r.pred_label): r.share for r in M.confusion_row_normalised(df).collect()}
    assert shares[("A", "A")] == 0.5 and shares[("C", "C")] == 0.0


def test_best_run_tie_goes_to_first_name(spark):
    df = spark.createDataFrame([("b", 1, "A", "A", "s"), ("a", 1, "A", "A", "s")], SCHEMA)
    assert M.best_run(df).first().run_name == "a"


def test_per_group_present_rule(spark):
    rows = [("r", 1, "A", "A", "x"), ("r", 2, "B", "A", "x"), ("r", 3, "C", "C", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    g = {r.specialty: r for r in M.per_group_metrics(df).collect()}
    assert g["x"]["count"] == 2 and g["x"].accuracy == 0.5
    assert g["x"].macro_f1 == pytest.approx(_sk_macro_f1(["A", "B"], ["A", "A"]))
    assert g["y"].macro_f1 == 1.0


def test_accuracy_pivot_order(spark):
    rows = [("r", 1, "A", "A", "s"), ("r", 2, "C", "A", "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    piv = M.accuracy_pivot(df, "gold_label", ["C", "B", "A"])
    assert piv.columns == ["run_name", "C", "A"]


def test_seed_aggregates_rules(spark):
    cfg = spark.createDataFrame([
        ("x", 0.5, 0.4), ("x_seed1337", 0.6, 0.5),          # suffix-less counts as 42
        ("y", 0.5, 0.4),                                     # no seeded sibling -> ignored
        ("z_seed7", 0.1, 0.1),                               # single seed -> dropped
        ("w", 0.9, 0.9), ("w_seed42", 0.2, 0.2), ("w_seed1", 0.4, 0.4),  # explicit 42 wins
    ], "run_name string, accuracy double, macro_f1 double")
    got = {r.run_name: r for r in M.seed_aggregates(cfg).collect()}
    assert set(got) == {"x", "w"}
    assert got["x"].seeds == "42,1337" and got["x"].accuracy == pytest.approx(0.55)
    assert got["x"].acc_std == pytest.approx(math.sqrt(0.005))
    assert got["w"].seeds == "1,42" and got["w"].accuracy == pytest.approx(0.3)


def test_seed_golden(spark):
    r = M.seed_aggregates(M.run_metrics(X.predictions(spark, SF001))).first()
    assert r.run_name == "alpha-8b_s1-none_s2-lora" and r.seeds == "42,1337,2024"
    assert round(r.accuracy, 8) == 0.49777778 and round(r.acc_std, 8) == 0.00668675


def test_perplexity_golden_and_nan(spark):
    ppl = {(r.model, r.variant): r for r in M.perplexity(X.token_loss(spark, SF001)).collect()}
    assert ppl[("A", "F")].n_tokens == 34150 and round(ppl[("A", "F")].perplexity, 6) == 7.757761
    assert ppl[("A", "O")].n_tokens == 34509 and round(ppl[("A", "O")].perplexity, 6) == 7.574657
    none = spark.createDataFrame([("m", "v", 0, 3.0)], "model string, variant string, n_target long, loss double")
    assert math.isnan(M.perplexity(none).first().perplexity)


def test_token_length_profile(spark):
    df = spark.createDataFrame([("c", n) for n in range(1, 101)], "corpus string, n_tokens long")
    r = M.token_length_profile(df, 90).first()
    assert r.p50 == pytest.approx(50.5) and r.p99 == pytest.approx(99.01) and r.share_truncated == 0.1
