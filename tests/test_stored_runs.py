"""Evaluation with stored predictions, batches of like length, corpus export with
caps and observed sizes, typed CSV of several row kinds."""

import hashlib
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import examples as E
from quarry.operators import scoring as R
from quarry.sources import evaluation as V
from quarry.sources import files as FS

QUESTION = ("question_id string, question string, option_a string, option_b string, option_c string, option_d string, "
            "option_e string, answer string, specialty string")


def counted(df, seen):
    """The same rows; ``seen`` counts every time a row is worked out."""
    def run(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf
    return df.mapInPandas(run, df.schema)


def lines(path):
    return [json.loads(ln) for f in sorted(os.listdir(path)) if f.endswith(".json")
            for ln in open(os.path.join(path, f), encoding="utf-8")]


def test_scored_once_for_all_sinks_and_recovery(spark, tmp_path):
    rows = [(str(i), f'say "{i}",\nagain', "a" * (i % 4), "bb", "c" * (i % 5), "d", "", "ABC"[i % 3], [None, "طب", "x"][i % 3]) for i in range(90)]
    seen = spark.sparkContext.accumulator(0)
    keep = ("question_id", "question", "answer", "specialty")

    def score():
        prompts = spark.createDataFrame(rows, QUESTION).select(*keep, E.prompt_mcq(False).alias("prompt"))
        scored = R.score_choices(counted(prompts, seen), R.OptionLengthScorer, "prompt", keep=keep)
        return R.assemble_predictions(scored, R.argmax_letter(), ["question_id", "specialty"], ("question",))

    out, table = str(tmp_path / "report"), str(tmp_path / "predictions")
    tokens = spark.createDataFrame([("B", 7), ("A", 5)], "letter string, token_id long")
    preds = V.evaluate_run(spark, "007", score, out, table, tokens)
    assert seen.value == len(rows)
    want = {r[0]: (r[7], "ABCDE"[int(np.argmax([len(o) for o in r[2:7]]))]) for r in rows}
    assert {r.question_id: (r.gold_label, r.pred_label) for r in preds.collect()} == want

    result, = lines(f"{out}/results")
    right = [g == p for g, p in want.values()]
    assert result["run_name"] == "007" and result["total_samples"] == 90 and result["accuracy"] == sum(right) / 90
    assert result["answer_token_ids"] == {"A": 5, "B": 7}
    assert {k: v["count"] for k, v in result["per_specialty_scores"].items()} == {"None": 30, "طب": 30, "x": 30}
    flat = {r.specialty: r for r in V.result_rows(FS.read_eval_results(spark, f"{out}/results")).collect()}
    assert flat["x"].answer_tokens == "A=5,B=7" and flat["x"].group_accuracy == sum(right[2::3]) / 30

    from quarry.sources.ordered import read_csv_quoted
    back = {r.question: r for r in read_csv_quoted(spark, f"{out}/predictions").collect()}
    assert len(back) == 90 and all((back[r[1]].reference, back[r[1]].prediction) == want[r[0]] for r in rows)

    # A job that starts again, or another report of the same run, reads the stored rows.
    again = V.evaluate_run(spark, "007", lambda: pytest.fail("scored again"), str(tmp_path / "second"), table, tokens)
    assert seen.value == len(rows) and again.count() == 90
    # Another run in the same folder is not taken for this one.
    assert V.stored_run(spark, table, "7").isEmpty() and V.stored_run(spark, str(tmp_path / "none"), "7").isEmpty()


def prompts_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, p string")


def test_prompts_in_batches_of_like_length(spark):
    rng = np.random.default_rng(3)
    texts = ["x" * int(n) for n in rng.integers(1, 400, 300)] + ["", None, "é😀", "y" * 5000]
    df = prompts_of(spark, texts).coalesce(1)
    got = {}
    for by_length in (True, False):
        out = R.score_prompts(df, R.TokenSumScorer, E.CharTokenizer, "p", ("id",), by_length=by_length).collect()
        assert [r.id for r in out] == list(range(len(texts)))  # the order of the rows is restored
        got[by_length] = out
    for r, plain in zip(got[True], got[False]):
        ids = E.CharTokenizer().encode(texts[r.id] or "")[:R.PROMPT_TOKENS]
        want = [float(sum(i * (2 * j + 3) % 97 for i in ids)) for j in range(5)]
        for row in (r, plain):
            assert [row[f"logit_{L}"] for L in "ABCDE"] == want and row.n_tokens == len(ids) <= row.padded_to <= 2048

    def padding(rows):
        return 1 - sum(r.n_tokens for r in rows) / sum(r.padded_to for r in rows)
    assert padding(got[True]) < 0.25 * padding(got[False])
    assert R.score_prompts(df.limit(0), R.TokenSumScorer, E.CharTokenizer, "p", ("id",)).count() == 0


def test_padding_is_on_the_left_with_its_mask(spark):
    class Seen:
        def __call__(self, ids, mask):
            assert ids.shape == mask.shape and ((ids == 9) == (mask == 0)).all()
            assert (np.diff(mask, axis=1) >= 0).all() and (mask[:, -1] == 1).all()
            return np.stack([ids[:, -1]] * 5, axis=1)

    out = R.score_prompts(prompts_of(spark, ["abc", "z", "ab"]), Seen, E.CharTokenizer, "p", ("id",), batch_size=2, pad_id=9).collect()
    assert {r.id: r.logit_A for r in out} == {0: ord("c") + 3, 1: ord("z") + 3, 2: ord("b") + 3}


def brute_split(ids, fraction, max_train, max_val, seed=42):
    order = sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), i or ""))
    k = math.ceil(fraction * len(order))
    val, train = order[:k], order[k:]
    return sorted(map(str, val[:max_val])), sorted(map(str, train[:max_train]))


@pytest.mark.parametrize("max_train,max_val", [(None, None), (0, 0), (50, None), (None, 7), (1000, 100), (10**9, 10**9), (333, 0), (1, 1)])
def test_caps_after_the_split(spark, max_train, max_val):
    ids = [f"q{i}" for i in range(1500)] + ["hot"] * 700 + [None] * 20  # a third of all rows share an id
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(5)
    out = E.split_exact(df, "id", 0.1, max_train=max_train, max_val=max_val)
    assert out.columns == ["id", "split"]
    rows = out.collect()
    got = tuple(sorted(str(r.id) for r in rows if r.split == side) for side in ("val", "train"))
    assert got == brute_split(ids, 0.1, max_train, max_val) and {r.split for r in rows} <= {"val", "train"}


def test_caps_of_no_rows_and_bad_caps(spark):
    none = spark.createDataFrame([], "id string")
    assert E.split_exact(none, "id", 0.1, max_train=3, max_val=2).count() == 0
    with pytest.raises(ValueError, match="cap"):
        E.split_exact(none, "id", 0.1, max_train=-1)


def test_export_counts_on_the_write(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("line\nof "), "id").alias("text"),
                                  F.when(F.col("id") % 10 == 0, "val").otherwise("train").alias("split"))
    path = str(tmp_path / "sft")
    meta = FS.write_sft_corpus(counted(df, seen), path, facts={"model_name": "org/m", "num_epochs": 3, "stage1": None}).first()
    assert seen.value == 1000  # one pass gives the files and their sizes
    assert (meta.train_samples, meta.val_samples, meta.model_name, meta.num_epochs, meta.stage1) == (900, 100, "org/m", 3, None)
    stored, = lines(f"{path}/_meta")
    assert stored["train_samples"] == 900 and stored["model_name"] == "org/m"
    back = FS.read_sft_corpus(spark, path, "id string, text string, split string")
    assert sorted(tuple(r) for r in back.collect()) == sorted(
        (r.id, r.text, r.split, 900 if r.split == "train" else 100) for r in df.collect())
    # One side only, and no rows at all.
    only = FS.write_sft_corpus(df.where("split = 'val'"), str(tmp_path / "val")).first()
    none = FS.write_sft_corpus(df.where("id < '0'"), str(tmp_path / "none")).first()
    assert (only.train_samples, only.val_samples, none.train_samples, none.val_samples) == (0, 100, 0, 0)
    with pytest.raises(ValueError, match="counted"):
        FS.write_sft_corpus(df, path, facts={"val_samples": 1})


def test_typed_csv_tells_null_empty_and_nan_apart(spark, tmp_path):
    schema = "kind string, name string, n long, x double"
    texts = [None, "", "NaN", "null", " padded ", 'a "quoted", cell', "two\nlines", "cr\rlf\r\n", '"', '""', ",", "\\", "\\\"", "é😀"]
    numbers = [None, 0.0, -0.0, float("nan"), float("inf"), float("-inf"), 0.1, 1e-300]
    rows = [("a", t, i, numbers[i % len(numbers)]) for i, t in enumerate(texts)]
    path = str(tmp_path / "t")
    FS.write_typed_csv(spark.createDataFrame(rows, schema).repartition(3), path, schema)
    back = FS.read_typed_csv(spark, path, schema)
    assert back.schema == spark.createDataFrame([], schema).schema
    assert [repr(tuple(r)) for r in back.orderBy("n").collect()] == [repr(r) for r in rows]
    # A kind that lacks columns, in another order; then a column that is not declared.
    FS.write_typed_csv(spark.createDataFrame([(3, "b")], "n int, kind string"), path, schema)
    assert [tuple(r) for r in FS.read_typed_csv(spark, path, schema).collect()] == [("b", None, 3, None)]
    with pytest.raises(ValueError, match="declared"):
        FS.write_typed_csv(spark.createDataFrame([(1,)], "other int"), path, schema)
    with pytest.raises(Exception, match="(?i)header|FAILED_READ_FILE"):
        FS.read_typed_csv(spark, path, "kind string, title string, n long, x double").collect()
