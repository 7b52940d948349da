"""Loading and cleaning: golden counters, step order, keep-first, fallbacks."""


from quarry.operators import catalog as K
from quarry.operators import cleaning as C
from quarry.plans.cleaning import loaded_mcq, loaded_open_qa
from tests.conftest import SF001

MCQ_SCHEMA = ("question_id string, row_idx long, question string, option_a string, option_b string, "
              "option_c string, option_d string, option_e string, answer string")


def _mcq(spark, rows):
    return C.fill_and_strip(spark.createDataFrame(rows, MCQ_SCHEMA))


def test_golden_counters(spark):
    r = C.clean_mcq_with_counters(loaded_mcq(spark, SF001)).first().asDict()
    assert r == {"original": 1000, "invalid_answers": 499, "empty_questions": 18, "missing_option_e": 87,
                 "duplicates": 16, "total_removed": 620, "final": 380}
    assert r["original"] - (r["invalid_answers"] + r["empty_questions"] + r["missing_option_e"]
                            + r["duplicates"]) == r["final"]
    assert C.clean_mcq(loaded_mcq(spark, SF001)).count() == 380


def test_open_qa_golden(spark):
    assert loaded_open_qa(spark, SF001).count() == 180


def test_drop_inconsistent_option(spark):
    rows = [("1", 0, "q1", "a", "b", "c", "d", None, "E"),
            ("2", 1, "q2", "a", "b", "c", "d", "   ", "E"),
            ("3", 2, "q3", "a", "b", "c", "d", "e", "E"),
            ("4", 3, "q4", "a", "b", "c", "d", " ", "D")]
    out = C.clean_mcq(_mcq(spark, rows))
    assert sorted(r.question_id for r in out.collect()) == ["3", "4"]


def test_dedup_counts_only_survivors_and_keeps_second(spark):
    # The first copy is removed by the answer step, so the second survives
    # and is not a duplicate.
    rows = [("1", 0, "same", "a", "b", "c", "d", "e", "Z"),
            ("2", 1, "same", "a", "b", "c", "d", "e", "B"),
            ("3", 2, "same", "a", "b", "c", "d", "e", "C"),
            ("4", 3, "other", "a", "b", "c", "d", "e", "a")]
    df = _mcq(spark, rows)
    out = {r.question_id: r.answer for r in C.clean_mcq(df).collect()}
    assert out == {"2": "B", "4": "A"}
    c = C.clean_mcq_with_counters(df).first()
    assert (c.invalid_answers, c.duplicates, c.final) == (1, 1, 2)


def test_dedup_independent_of_partitioning(spark):
    mcq = loaded_mcq(spark, SF001)
    a = sorted(r.question_id for r in C.clean_mcq(mcq).collect())
    b = sorted(r.question_id for r in C.clean_mcq(mcq.repartition(7)).collect())
    assert a == b


def test_coalesce_question_null_only(spark):
    raw = spark.createDataFrame([
        (None, "title a", "ans"), ("   ", "title b", "ans"), ("desc", "title c", "ans"), (None, None, "ans"),
        ("d", "t", None)], "`Question description` string, `Question title` string, `Answer details 1` string")
    got = sorted(tuple(r) for r in C.load_open_qa(raw).collect())
    assert got == [("desc", "ans"), ("title a", "ans")]


def test_assign_question_id(spark):
    uniq = spark.createDataFrame([(5,), (7,), (None,)], "`Question Number` long")
    assert sorted(r.question_id or "" for r in C.assign_question_id(uniq).collect()) == ["", "5", "7"]
    dup = spark.createDataFrame([(5,), (5,), (7,)], "`Question Number` long")
    assert sorted(r.question_id for r in C.assign_question_id(dup).collect()) == ["0", "1", "2"]
    two_null = spark.createDataFrame([(None,), (None,), (7,)], "`Question Number` long")
    assert sorted(r.question_id for r in C.assign_question_id(two_null).collect()) == ["0", "1", "2"]


def test_project_present_columns(spark):
    df = spark.createDataFrame([("q", "A", "x")], "Question string, `Correct Answer` string, Extra string")
    out = C.project_present_columns(df, C.MCQ_COLUMNS)
    assert out.columns == ["question", "answer"]
    filled = C.fill_and_strip(out)
    assert "option_e" in filled.columns and filled.first()["option_e"] == ""


def test_label_domain_violations(spark):
    df = spark.createDataFrame([("A", "B"), ("X", "A"), (None, "C")], "gold_label string, pred_label string")
    v = {tuple(r) for r in C.label_domain_violations(df, ["gold_label", "pred_label"]).collect()}
    assert v == {("gold_label", "X", 1), ("gold_label", None, 1)}


def test_dedupe_run_log_rules(spark):
    rows = [(1, "a", "finished", None), (2, "a", "finished", 0.5),   # finished w/o acc, then with
            (3, "b", "failed", None), (4, "b", "finished", None),      # failed then finished
            (5, "c", "finished", 0.1), (6, "c", "finished", 0.9),      # two finished with acc -> first
            (7, "d", "crashed", None), (8, "d", "running", None)]      # nothing finished -> first
    log = spark.createDataFrame(rows, "event_id long, run_name string, state string, accuracy double")
    got = {r.run_name: r.event_id for r in K.dedupe_run_log(log).collect()}
    assert got == {"a": 2, "b": 4, "c": 5, "d": 7}


def test_dataset_overview(spark):
    sizes = spark.createDataFrame([("mcq", "train_raw", 19891), ("mcq", "train_clean", 17638)],
                                  "dataset string, split string, samples long")
    r = {x.split: x for x in C.dataset_overview(sizes).collect()}
    assert r["train_clean"].removed == 2253 and r["train_clean"].removal_pct == 11.33
    assert r["train_raw"].removed is None
