"""Statistics: McNemar edge rows, exact binomial, bootstrap properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import inference as I
from quarry.sources import fixtures as X
from tests.conftest import SF0001, SF001


def _binom_p(b, c):
    n, k = b + c, min(b, c)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2 ** n)


@pytest.mark.parametrize("b,c", [(0, 0), (3, 21), (12, 12), (10, 15), (20, 20), (1, 0), (30, 5)])
def test_mcnemar_rules(spark, b, c):
    df = spark.createDataFrame([(b, c)], "b long, c long")
    r = df.select(*I.mcnemar_columns(F.col("b"), F.col("c"))).first()
    n = b + c
    if n == 0:
        assert (r.mcnemar_stat, r.mcnemar_p, r.mcnemar_kind) == (0.0, 1.0, "exact")
    elif n < 25:
        assert r.mcnemar_kind == "exact" and r.mcnemar_stat == min(b, c)
        assert r.mcnemar_p == pytest.approx(_binom_p(b, c), rel=1e-12)
    else:
        stat = (abs(b - c) - 1) ** 2 / n
        assert r.mcnemar_kind == "chi2_cc" and r.mcnemar_stat == pytest.approx(stat)
        assert r.mcnemar_p == pytest.approx(math.erfc(math.sqrt(stat / 2)), rel=1e-12)
    if (b, c) == (20, 20):
        assert r.mcnemar_stat == pytest.approx(1 / 40)


def test_mcnemar_golden_and_symmetry(spark):
    preds = X.predictions(spark, SF001)
    contrasts = I.find_contrasts(preds, X.models(spark))
    assert contrasts.count() == 3
    mc = {r.contrast: r for r in I.mcnemar(I.paired_predictions(preds, contrasts)).collect()}
    a = mc["alpha-8b_s1-none_s2-full vs alpha-8b_s1-none_s2-lora"]
    b = mc["beta-8b_s1-none_s2-full vs beta-8b_s1-none_s2-lora"]
    assert (a.mcnemar_b, a.mcnemar_c) == (4341, 4044)
    assert (b.mcnemar_b, b.mcnemar_c) == (4402, 4284)
    swapped = contrasts.select("model", "stage1", "contrast", F.col("run_lora").alias("run_full"),
                               F.col("run_full").alias("run_lora"))
    sw = {r.contrast: r for r in I.mcnemar(I.paired_predictions(preds, swapped)).collect()}
    s = sw["alpha-8b_s1-none_s2-full vs alpha-8b_s1-none_s2-lora"]
    assert (s.mcnemar_b, s.mcnemar_c, s.mcnemar_stat) == (4044, 4341, a.mcnemar_stat)


def test_hash_bootstrap_replicate0_golden(spark):
    r = I.bootstrap_hash_replicates(X.predictions(spark, SF001), 1).where(
        "run_name = 'alpha-8b_s1-lora_s2-full'").first()
    assert (r.n_correct, r.n) == (7764, 15069)


def test_hash_bootstrap_brute_force(spark):
    """Blocks, repeated rows, a null question and the whole Poisson tail; other labels are an error."""
    import hashlib
    from collections import Counter

    assert len(I.POISSON_THRESHOLDS) > 10 and I.POISSON_THRESHOLDS[:2] == (1580030168, 3160060337)
    rows = [(f"r{i % 3}", i // 3 % 40, "ABCDE"[i % 5], "ABCDE"[i * 7 % 5]) for i in range(150)]
    rows += [("r0", 7, "A", "A")] * 30 + [("r2", None, "A", "A")]
    want = Counter()
    for run, q, gold, pred in rows:
        for rep in range(23 if q is not None else 0):
            h = int(hashlib.md5(f"{q}:{rep}".encode()).hexdigest()[:8], 16)
            w = sum(h >= t for t in I.POISSON_THRESHOLDS)
            want[run, rep, "n"] += w
            want[run, rep, "n_correct"] += w * (gold == pred)
            if pred and gold != "?":
                want[run, rep, f"n_{gold}{pred}"] += w
    df = spark.createDataFrame(rows, "run_name string, question_id long, gold_label string, pred_label string")
    got = I.bootstrap_hash_replicates(df, 23, block=5).collect()
    assert len(got) == 3 * 23
    for r in got:
        d = r.asDict()
        assert all(v == want[r.run_name, r.rep, k] for k, v in d.items() if k not in ("run_name", "rep"))
    for bad in (("r1", 1, "?", "?"), ("r1", 2, "A", None)):
        with pytest.raises(Exception, match="labels outside ABCDE or null in run r1"):
            I.bootstrap_hash_replicates(spark.createDataFrame(rows + [bad], df.schema), 3).collect()


def test_hash_weights_one_digest_per_replicate():
    """One md5 of question and replicate per weight: texts of any length, numbers of any digits (F2)."""
    import hashlib

    questions = ["1", "23", "é🙂", "", "x" * 44, "x" * 51, "y" * 200]
    got = I.replicate_weights(questions, 95, 1000)
    for q, row in zip(questions, got, strict=True):
        hashes = [int(hashlib.md5(f"{q}:{rep}".encode()).hexdigest()[:8], 16) for rep in range(95, 1095)]
        assert row.tolist() == [sum(h >= t for t in I.POISSON_THRESHOLDS) for h in hashes]
    edge = I.POISSON_THRESHOLDS[0] >> 16
    assert I._SPLIT_UPPER[edge] and not I._SPLIT_UPPER[edge - 1]


def test_hash_bootstrap_sql_hashes_every_replicate(spark):
    from quarry.plans import statistics as plans

    for key in ("bootstrap_hash_200", "bootstrap_hash_rep0"):
        assert "rep // 4" not in plans.ORACLE[key] and "':' || cast(rep as varchar)" in plans.ORACLE[key]


def test_hash_bootstrap_shuffles_rows_once(spark):
    """No row per block of replicates; equal rows of a batch travel as one."""
    import pyarrow as pa

    df = X.predictions(spark, SF0001)
    plan = I.bootstrap_hash_replicates(df, 10_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and "inline" not in plan  # the runs of the fixture
    assert plan.count("Exchange hashpartitioning(question") == 1
    rows = [("7", "a", 3)] * 500 + [("7", None, 3), ("8", "b", 24), ("7", "a", 0)]
    b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))],
                                   names=["question", "run_name", "cell"])
    (got,) = I._by_question([b])
    assert got.to_pylist() == [{"question": "7", "runs": ["a", "a", None], "cells": b"\0\3\3", "n": [1, 500, 1]},
                               {"question": "8", "runs": ["b"], "cells": b"\x18", "n": [1]}]
    assert list(I._by_question([b.slice(0, 0)]))[0].num_rows == 0
    sums = {}
    for out in I._weighted_cells([got, got], 30, 7):
        for r in out.to_pylist():
            sums[r["run_name"], r["rep"]] = [r[c] for c in I.CELLS]
    w = I.replicate_weights(["7", "8"], 0, 30)
    assert [sums["a", k][3] for k in range(30)] == (1000 * w[0].astype(int)).tolist()
    assert [sums[None, k][3] for k in range(30)] == (2 * w[0].astype(int)).tolist()
    assert [sums["b", k][24] for k in range(30)] == (2 * w[1].astype(int)).tolist()


def test_hash_bootstrap_works_on_numbers_and_whole_blocks(spark, monkeypatch):
    """Whole numbers stay numbers up to their digest, and numbers of any digits and a million
    weights are worked out together (F4)."""
    import pyarrow as pa

    schema = "run_name string, question_id {}, gold_label string, pred_label string"
    rows = [(f"r{i % 3}", (i * 37 % 90 - 20) * 10 ** (i % 5), "ABCDE"[i % 5], "ABCDE"[i * 3 % 5]) for i in range(200)]
    numbers = spark.createDataFrame(rows, schema.format("long"))
    plan = I.bootstrap_hash_replicates(numbers, 12)._jdf.queryExecution().executedPlan().toString()
    assert "as string" not in plan
    texts = spark.createDataFrame([(r, str(q), *rest) for r, q, *rest in rows], schema.format("string"))
    got, want = (sorted(tuple(r) for r in I.bootstrap_hash_replicates(df, 12, block=5).collect()) for df in (numbers, texts))
    assert got == want and len(got) == 36

    calls = []
    kernel, weights = I._first_word, I.replicate_weights
    monkeypatch.setattr(I, "_first_word", lambda words, shape: calls.append(shape) or kernel(words, shape))
    I.first_bits([b"12:", b"13:"], 0, 200)
    assert calls == [(2, 200)]
    monkeypatch.setattr(I, "_first_word", kernel)
    calls.clear()
    monkeypatch.setattr(I, "replicate_weights", lambda q, first, size: calls.append((len(q), first, size)) or weights(q, first, size))
    b = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["a", "b", None] * 1000), pa.array([k % 25 for k in range(3000)], pa.int32())],
                                   names=["question", "run_name", "cell"])
    sums = list(I._weighted_cells(I._by_question([b]), 20, 15))
    assert calls == [(3000, 0, 15), (3000, 15, 5)]
    drawn = weights(range(3000), 0, 20).astype(int)
    for run, at in (("a", 0), ("b", 1), (None, 2)):
        mine = sorted((r for out in sums for r in out.to_pylist() if r["run_name"] == run), key=lambda r: r["rep"])
        for k, name in enumerate(I.CELLS):
            own = [i for i in range(at, 3000, 3) if i % 25 == k]
            assert [r[name] for r in mine] == drawn[own].sum(axis=0).tolist()


def test_hash_bootstrap_counts_no_bytes_per_row(spark, monkeypatch):
    """The byte limit of Arrow batches is lifted for its one action and is back afterwards, errors included."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    seen, cut = [], I.cut_lineage
    monkeypatch.setattr(I, "cut_lineage", lambda df: seen.append(spark.conf.get(limit)) or cut(df))
    schema = "run_name string, question_id long, gold_label string, pred_label string"
    (r,) = I.bootstrap_hash(spark.createDataFrame([("r", i, "A", "AB"[i % 2]) for i in range(50)], schema), 9).collect()
    assert (r.run_name, r.n_boot) == ("r", 9) and spark.conf.get(limit) == before != seen[0]
    with pytest.raises(Exception, match="labels outside ABCDE or null in run r"):
        I.bootstrap_hash(spark.createDataFrame([("r", 1, "A", "?")], schema), 9).collect()
    assert spark.conf.get(limit) == before


def test_bootstrap_close_to_index_resampling(spark):
    """Multinomial over cells vs NumPy index resampling on the same run."""
    preds = X.predictions(spark, SF001).where("run_name = 'alpha-8b_s1-none_s2-full'")
    ci = I.bootstrap_ci(preds, n_boot=4000).first()
    pdf = preds.select("gold_label", "pred_label").toPandas()
    codes = pdf.gold_label.map("ABCDE".index).to_numpy() * 5 + pdf.pred_label.map("ABCDE".index).to_numpy()
    rng = np.random.default_rng(42)
    accs, f1s = [], []
    for _ in range(4000):
        cm = np.bincount(codes[rng.integers(0, len(codes), len(codes))], minlength=25).reshape(1, 5, 5)
        a, f = I._acc_f1(cm)
        accs.append(a[0])
        f1s.append(f[0])
    assert ci.acc_ci_lo == pytest.approx(np.percentile(accs, 2.5), abs=0.002)
    assert ci.acc_ci_hi == pytest.approx(np.percentile(accs, 97.5), abs=0.002)
    assert ci.f1_ci_lo == pytest.approx(np.percentile(f1s, 2.5), abs=0.002)
    assert ci.accuracy == pytest.approx(7739 / 15000)


def test_bootstrap_independent_of_partitioning(spark):
    preds = X.predictions(spark, SF001).where("run_name like 'beta%'")
    a = sorted(tuple(r) for r in I.bootstrap_ci(preds, n_boot=1500).collect())
    b = sorted(tuple(r) for r in I.bootstrap_ci(preds.repartition(5), n_boot=1500).collect())
    assert a == b


def test_paired_bootstrap_p_floor_and_sign(spark):
    preds = X.predictions(spark, SF001)
    rep = {r.run_name: r for r in I.contrast_report(preds, X.models(spark), n_boot=2000).collect()}
    r = rep["alpha-8b_s1-lora_s2-full vs alpha-8b_s1-lora_s2-lora"]
    assert r.f1_delta > 0 and r.f1_delta_ci_lo > 0
    assert r.f1_delta_p == pytest.approx(2 / 2001)
    assert r.acc_delta == pytest.approx((7672 - 6993) / 15000)


def test_align_pair_counts(spark):
    r = I.align_pair(X.predictions(spark, SF001), "alpha-8b_s1-none_s2-full", "beta-8b_s1-none_s2-full").first()
    assert (r.rows_a, r.rows_b, r.aligned, r.gold_disagreements) == (15000, 15000, 15000, 0)


def test_registered_hash_bootstrap_runs_all_replicates(spark, monkeypatch):
    """The registered query over a small fixture: 10,000 replicates, bounds by brute force."""
    import hashlib

    from quarry.plans import statistics as plans

    rows = [(f"r{i % 2}", i // 2, "ABCDE"[i % 5], "ABCDE"[i * i % 5 if i % 3 else i % 5]) for i in range(16)]
    df = spark.createDataFrame(rows, "run_name string, question_id long, gold_label string, pred_label string")
    monkeypatch.setattr(plans, "_preds", lambda spark, sf: df)
    weights = np.array([[int(hashlib.md5(f"{q}:{rep}".encode()).hexdigest()[:8], 16) for q in range(8)] for rep in range(10_000)])
    weights = (weights[:, :, None] >= np.array(I.POISSON_THRESHOLDS)).sum(axis=2)
    got = {r.run_name: r for r in plans.QUERIES["bootstrap_hash"](spark, None).collect()}
    assert sorted(got) == ["r0", "r1"]
    for run, r in got.items():
        cm = np.zeros((10_000, 5, 5))
        for name, q, gold, pred in rows:
            if name == run:
                cm[:, "ABCDE".index(gold), "ABCDE".index(pred)] += weights[:, q]
        cm = cm[weights.sum(axis=1) > 0]
        hits, total = np.trace(cm, axis1=1, axis2=2), cm.sum(axis=(1, 2))
        own = np.einsum("rkk->rk", cm)
        sides = cm.sum(axis=1) + cm.sum(axis=2)
        f1 = np.divide(2 * own, sides, out=np.zeros_like(own), where=sides > 0).mean(axis=1)
        want = [*np.percentile(hits / total, [2.5, 97.5]), *np.percentile(f1, [2.5, 97.5])]
        assert r.n_boot == len(cm) > 9_900
        assert [r.acc_ci_lo, r.acc_ci_hi, r.f1_ci_lo, r.f1_ci_hi] == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("bad, what", [(("B", "B", "Z", "B"), "outside the letters"), (("B", "B", None, "B"), "outside the letters"),
                                       (("A", "B", "A", "B"), "gold labels disagree"), ((None, None, "A", "B"), "outside the letters")])
def test_paired_statistics_refuse_bad_labels(spark, bad, what):
    schema = "contrast string, question_id long, gold_a string, gold_b string, pred_a string, pred_b string"
    good = [("c", i, "B", "B", "B", "ABCDE"[i % 5]) for i in range(50)]
    paired = spark.createDataFrame(good, schema)
    assert I.mcnemar(paired).first().n == 50
    broken = spark.createDataFrame(good + [("c", 99, *bad)], schema)
    for statistic in (lambda: I.mcnemar(broken).collect(), lambda: I.paired_bootstrap_delta(broken, 10).collect()):
        with pytest.raises(Exception, match=what):
            statistic()
