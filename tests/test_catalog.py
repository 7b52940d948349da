"""Experiment catalog: run-name rules, matrices, resume logic, best config."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import catalog as K
from quarry.sources import fixtures as X


@pytest.mark.parametrize("name,group", [
    ("m_s1-none_s2-lora_seed1337", "multi-seed"), ("m_s1-none_s2-qlora", "qlora"),
    ("m_s1-none_s2-lora_r32", "sweep"), ("m_s1-none_s2-lora_lr1e-4", "sweep"), ("m_s1-none_s2-lora_do0.0", "sweep"),
    ("m_s1-none_s2-lora_attnonly", "sweep"), ("qwen-7b_s1-none_s2-full", "new-models"),
    ("m_s1-none_s2-none", "zero-shot"), ("m_s1-lora_s2-none", "stage1-only"), ("m_s1-none_s2-full", "stage2-only"),
    ("m_s1-full3ep_s2-full", "two-stage"), ("m_s1-lora_s2-lora", "two-stage"),
])
def test_run_group(spark, name, group):
    df = spark.createDataFrame([(name,)], "run_name string")
    assert df.select(K.run_group(F.col("run_name"))).first()[0] == group


def test_parse_run_name(spark):
    runs = spark.createDataFrame([("alpha-8b_s1-full3ep_s2-qlora_x",), ("zeta_s1-none_s2-none",), ("bad",),
                                  ("alpha-8b_s1-none_s2-none",)], "run_name string")
    got = {r.run_name: r for r in K.parse_run_name(runs, X.models(spark)).collect()}
    assert set(got) == {"alpha-8b_s1-full3ep_s2-qlora_x", "alpha-8b_s1-none_s2-none"}
    r = got["alpha-8b_s1-full3ep_s2-qlora_x"]
    assert (r.stage1_method, r.stage2_method, r.qlora, r.suffix) == ("full", "lora", True, "_x")
    assert got["alpha-8b_s1-none_s2-none"].suffix is None


def _acc(spark, rows):
    return spark.createDataFrame(rows, "run_name string, accuracy double")


def test_best_rank_fallback_and_tie(spark):
    m = X.models(spark).where("short_name = 'alpha-8b'")
    base = "alpha-8b_s1-none_s2-lora"
    partial = _acc(spark, [(base, 0.5), (base + "_r32", 0.6)])
    r = K.best_rank(m, partial).first()
    assert (r.r, r.resolved) == (16, False) and "missing r=8,64" in r.note
    full = _acc(spark, [(base + "_r8", 0.6), (base, 0.5), (base + "_r32", 0.6), (base + "_r64", 0.1)])
    r = K.best_rank(m, full).first()
    assert (r.r, r.resolved) == (8, True)   # tie 8 vs 32 -> smaller rank


def test_best_config_one_factor_at_a_time(spark):
    m = X.models(spark).where("short_name = 'alpha-8b'")
    base = "alpha-8b_s1-none_s2-lora"
    acc = _acc(spark, [(base + "_r8", 0.5), (base, 0.5), (base + "_r32", 0.7), (base + "_r64", 0.6),
                       (base + "_lr1e-4", 0.7), (base + "_lr4e-4", 0.8),
                       (base + "_do0.0", 0.6), (base + "_do0.1", 0.69)])
    r = K.best_config(m, acc).first()
    assert (r.r, r.alpha, r.lr, r.dropout, r.resolved) == (32, 64, "4e-4", "0.05", True)
    acc2 = _acc(spark, [(base + "_r8", 0.5), (base, 0.5), (base + "_r32", 0.7), (base + "_r64", 0.6),
                        (base + "_lr1e-4", 0.7)])
    r2 = K.best_config(m, acc2).first()
    assert (r2.lr, r2.lr_resolved, r2.resolved) == ("2e-4", False, False)   # tie -> baseline; missing -> fallback
    t = K.transfer_config(X.models(spark), acc).first()
    assert (t.source_model, t.r, t.lr, t.resolved) == ("alpha-8b", 32, "4e-4", True)
    t2 = K.transfer_config(X.models(spark), acc2).first()
    assert (t2.source_model, t2.r, t2.alpha, t2.lr, t2.dropout, t2.resolved) == (None, 16, 32, "2e-4", "0.05", False)


def test_skip_completed_reason_priority(spark):
    planned = spark.createDataFrame([("a",), ("b",), ("c",)], "run_name string")
    log = spark.createDataFrame([("a", 0.5), ("b", None)], "run_name string, accuracy double")
    local = spark.createDataFrame([("a",), ("c",)], "run_name string")
    got = {r.run_name: r.status for r in K.skip_completed(planned, log, local).collect()}
    assert got == {"a": "SKIP(tracker finished run)", "b": "SKIP(tracker finished run)",
                   "c": "SKIP(local eval results)"}
    assert K.plan_summary(K.skip_completed(planned, log.where("false"), local.where("false"))).first().launch == 3


def test_run_matrix_names(spark):
    names = {r.run_name for r in K.build_run_matrix(X.models(spark)).collect()}
    assert "alpha-8b_s1-none_s2-lora_seed1337" in names and "alpha-8b_s1-none_s2-lora_r8" in names
    assert "alpha-8b_s1-none_s2-lora_lr1e-4" in names and "alpha-8b_s1-none_s2-lora_do0.1" in names
    assert "gamma-7b_s1-none_s2-none" in names and "alpha-8b_s1-none_s2-lora" not in names
    assert K.existing_conditions(X.models(spark)).count() == 14


SPEC = "run_name string, short_name string, model_id string, stage1_method string, stage2_method string, " \
       "phase string, train boolean"


def test_reinfer_plan_actions(spark):
    specs = spark.createDataFrame([
        ("m_s1-none_s2-none", "m", "id", "none", "none", "reinfer", False),   # zero-shot, no predictions
        ("m_s1-none_s2-lora", "m", "id", "none", "lora", "reinfer", False),   # has predictions
        ("m_s1-lora_s2-full", "m", "id", "lora", "full", "reinfer", False),   # needs stage2, absent
        ("m_s1-lora_s2-none", "m", "id", "lora", "none", "reinfer", False),   # needs stage1, present
    ], SPEC)
    preds = spark.createDataFrame([("m_s1-none_s2-lora",)], "run_name string")
    ck = spark.createDataFrame([("m_s1-lora_s2-none", "stage1"), ("m_s1-lora_s2-full", "stage1")],
                               "run_name string, stage string")
    got = {r.run_name: r.action for r in K.reinfer_plan(specs, preds, ck).collect()}
    assert got == {"m_s1-none_s2-none": "REINFER", "m_s1-none_s2-lora": "SKIP",
                   "m_s1-lora_s2-full": "MISSING CHECKPOINT", "m_s1-lora_s2-none": "REINFER"}


def test_collect_specs_first_wins(spark):
    known = spark.createDataFrame([("a", "m", "id", "none", "none", "reinfer", False)], SPEC)
    scanned = spark.createDataFrame([("a", "m", "id", "lora", "lora", "scan", True),
                                     ("b", "m", "id", "none", "full", "scan", True)], SPEC)
    got = {r.run_name: r.phase for r in K.collect_specs(known, scanned).collect()}
    assert got == {"a": "reinfer", "b": "scan"}


def test_sorted_report_order(spark):
    cfg = spark.createDataFrame([(n,) for n in ["z_s1-none_s2-full", "a_s1-lora_s2-lora", "b_s1-none_s2-none",
                                                "a_s1-none_s2-none", "x_s1-none_s2-lora_seed7"]], "run_name string")
    got = [r.run_name for r in K.sorted_report(cfg).collect()]
    assert got == ["a_s1-none_s2-none", "b_s1-none_s2-none", "z_s1-none_s2-full", "a_s1-lora_s2-lora",
                   "x_s1-none_s2-lora_seed7"]


def _plan(spark, acc, models=None):
    rows = K.run_plan(models or X.models(spark), acc, "beta-8b").collect()
    assert len({r.run_name for r in rows}) == len(rows)
    return {r.run_name: r for r in rows}


FULL_SWEEP = {"": 0.5, "_r8": 0.5, "_r32": 0.71236, "_r64": 0.6, "_lr1e-4": 0.7, "_lr4e-4": 0.8, "_do0.0": 0.6, "_do0.1": 0.69}
BEST = "best rank r=32 (acc=0.7124); best lr=4e-4; best dropout=0.05"


def test_run_plan_follows_results(spark):
    alpha = "alpha-8b_s1-none_s2-lora"
    plan = _plan(spark, _acc(spark, [(alpha + v, a) for v, a in FULL_SWEEP.items()]))
    got = lambda name: (list(plan[name].extra_args), plan[name].note)
    rank = ["--lora_r", "32", "--lora_alpha", "64"]
    assert got(alpha + "_r64") == (["--lora_r", "64", "--lora_alpha", "128"], "rank sweep r=64, alpha=128")
    assert got(alpha + "_lr1e-4") == ([*rank, "--learning_rate", "0.0001"], "LR ablation at best rank r=32 (acc=0.7124)")
    assert got(alpha + "_do0.0") == ([*rank, "--lora_dropout", "0.0"], "dropout ablation at best rank r=32 (acc=0.7124)")
    assert got(alpha + "_attnonly")[0] == [*rank, "--lora_target_modules", "q_proj,k_proj,v_proj,o_proj"]
    best = [*rank, "--learning_rate", "0.0004", "--lora_dropout", "0.05"]
    assert got("alpha-8b_s1-none_s2-qlora") == (["--qlora", *best], f"QLoRA; {BEST}")
    # The new model takes over the resolved configuration; its other runs have no arguments.
    assert got("gamma-7b_s1-none_s2-lora") == (best, f"Stage-2 LoRA; transferred from alpha-8b sweep ({BEST})")
    assert got("gamma-7b_s1-none_s2-none") == ([], "zero-shot baseline") and not plan["gamma-7b_s1-none_s2-none"].train
    assert got("gamma-7b_s1-none_s2-full") == ([], "Stage-2 full fine-tuning (Table 2 conventions)")
    assert got("alpha-8b_s1-none_s2-full_seed2024") == (["--seed", "2024"], "multi-seed rerun (seed 2024)")
    # A model without results keeps its own fallback.
    missing = "rank sweep incomplete (missing r=8,16,32,64); falling back to r=16"
    assert got("beta-8b_s1-none_s2-lora_lr4e-4") == (["--lora_r", "16", "--lora_alpha", "32", "--learning_rate", "0.0004"],
                                                     f"LR ablation at {missing}")
    assert got("beta-8b_s1-none_s2-qlora")[1] == (
        f"QLoRA; {missing}; LR sweep incomplete; falling back to lr=2e-4; dropout sweep incomplete; falling back to dropout=0.05; "
        "NOTE: using fallback Table 2 values for unresolved factors")
    diagnostic = plan["beta-8b_s1-full3ep_s2-full"]
    assert (diagnostic.stage1_method, diagnostic.stage2_method, diagnostic.phase, list(diagnostic.extra_args)) == (
        "full", "full", "stage1diag", ["--stage1_epochs", "3"])
    # The runs are those of the matrix, and the diagnostic.
    assert set(plan) - {diagnostic.run_name} == {r.run_name for r in K.build_run_matrix(X.models(spark)).collect()}


def test_run_plan_without_results_or_models(spark):
    none = _acc(spark, [])
    plan = _plan(spark, none)
    assert list(plan["gamma-7b_s1-none_s2-lora"].extra_args) == [
        "--lora_r", "16", "--lora_alpha", "32", "--learning_rate", "0.0002", "--lora_dropout", "0.05"]
    assert plan["gamma-7b_s1-none_s2-lora"].note == (
        "Stage-2 LoRA; Task 3 sweep not finished -> fallback r=16/alpha=32/lr=2e-4/dropout=0.05 all-linear (noted)")
    assert _plan(spark, none, X.models(spark).limit(0)) == {}


def test_transfer_prefers_the_better_model_and_then_the_first(spark):
    for better, source in ((0.9, "beta-8b"), (FULL_SWEEP["_r32"], "alpha-8b")):
        rows = [(f"{m}_s1-none_s2-lora{v}", better if (m, v) == ("beta-8b", "_r32") else a)
                for m in ("alpha-8b", "beta-8b") for v, a in FULL_SWEEP.items()]
        assert K.transfer_config(X.models(spark), _acc(spark, rows)).first().source_model == source
    r = K.best_rank(X.models(spark).where("existing"), _acc(spark, rows[:2])).first()
    assert r.accuracy is None and not r.resolved
