"""File sources and sinks with temporary-folder round trips."""

import json
import os
import tempfile

import pytest


from quarry.operators import metrics as M
from quarry.sources import files as FS
from quarry.sources import fixtures as X
from tests.conftest import SF001


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_csv_strict_and_tolerant(spark):
    d = tempfile.mkdtemp(prefix="quarry-csv-")
    ok = _write(d, "ok.csv", 'id,q,a\n1,"multi\nline",A\n2,short\n3,"say ""hi""",NA\n')
    rows, mode = FS.read_csv_two_pass(spark, ok)
    assert mode == "strict"
    assert [tuple(r) for r in rows.collect()] == [("1", "multi\nline", "A"), ("2", "short", None),
                                                  ("3", 'say "hi"', None)]
    over = _write(d, "over.csv", "id,q,a\n1,x,A\n2,y,B,extra\n3,z\n")
    rows, mode = FS.read_csv_two_pass(spark, over)
    assert mode == "tolerant"
    assert [tuple(r) for r in rows.collect()] == [("1", "x", "A"), ("3", "z", None)]
    stray = _write(d, "stray.csv", 'id,q,a\n1,stray "quote,A\n2,b,C\n')  # no quoted cell: pandas reads it strictly
    rows, mode = FS.read_csv_two_pass(spark, stray)
    assert mode == "strict"
    assert [tuple(r) for r in rows.collect()] == [("1", 'stray "quote', "A"), ("2", "b", "C")]
    unterminated = _write(d, "unterm.csv", 'id,q,a\n1,"stray quote,A\n2,b,C\n')
    rows, mode = FS.read_csv_two_pass(spark, unterminated)
    assert mode == "tolerant"
    assert [tuple(r) for r in rows.collect()] == [("1", '"stray quote', "A"), ("2", "b", "C")]


def test_csv_decides_per_file(spark):
    """Quotes inside unquoted cells are characters; two files with one open quote each are both tolerant."""
    d = tempfile.mkdtemp(prefix="quarry-csv-")
    _write(d, "a b.csv", 'id,q,a\n1,"two\nlines",A\n2,lesion 5" wide,B\n')
    rows, mode = FS.read_csv_two_pass(spark, d)
    assert mode == "strict"
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "two\nlines", "A"), ("2", 'lesion 5" wide', "B")]
    _write(d, "c.csv", 'id,q,a\n3,"open,A\n4,x,B\n')
    _write(d, "e.csv", 'id,q,a\n5,"open,A\n6,x,B,more\n')
    rows, mode = FS.read_csv_two_pass(spark, d)
    assert mode == "mixed"
    assert sorted(tuple(r) for r in rows.collect()) == [
        ("1", "two\nlines", "A"), ("2", 'lesion 5" wide', "B"), ("3", '"open', "A"), ("4", "x", "B"), ("5", '"open', "A")]


def test_csv_open_quote_over_splits(spark):
    d = tempfile.mkdtemp(prefix="quarry-csv-")
    body = "".join(f'{i},"cell ""{i}""\nnext, line",A\n' for i in range(3000))
    _write(d, "long.csv", "id,q,a\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows, mode = FS.read_csv_two_pass(spark, d)
        assert mode == "strict" and rows.count() == 3000
        _write(d, "long.csv", "id,q,a\n" + body + '3000,"open,A\n')
        assert FS.read_csv_two_pass(spark, d)[1] == "tolerant"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("line", ["", '"', 'a,"b', 'a"b', '"a""', '"a"b"c,"d"', '""', 'x,""', '","', 'a,"b""",c', '"a""b,"'])
def test_ends_in_quotes(line):
    """As pandas' parser finds it, after a closed and after an open cell."""
    import io

    import pandas as pd

    for inside in (False, True):
        text = "h,i,j\n" + ('"z\n' if inside else "z\n") + line + "\n"
        try:
            pd.read_csv(io.StringIO(text))
            found = False
        except pd.errors.ParserError as e:
            assert "EOF inside string" in str(e)
            found = True
        assert FS.ends_in_quotes(line, inside) == found


def test_predictions_roundtrip_and_dynamic_overwrite(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="quarry-pred-"), "predictions")
    preds = X.predictions(spark, SF001)
    FS.write_predictions(preds, d)
    back = FS.scan_predictions(spark, d)
    a = sorted(tuple(r) for r in M.run_metrics(preds).collect())
    b = sorted(tuple(r) for r in M.run_metrics(back).collect())
    assert a == b
    # Rewriting one run leaves the others in place.
    one = preds.where("run_name = 'beta-8b_s1-none_s2-none'").limit(10)
    FS.write_predictions(one, d)
    counts = {r.run_name: r["count"] for r in FS.scan_predictions(spark, d).groupBy("run_name").count().collect()}
    assert counts["beta-8b_s1-none_s2-none"] == 10 and counts["alpha-8b_s1-none_s2-full"] == 15000


def test_scan_per_run_files(spark):
    d = tempfile.mkdtemp(prefix="quarry-perrun-")
    preds = X.predictions(spark, SF001).drop("run_name")
    for name in ("x_s1-none_s2-lora", "y_s1-none_s2-full"):
        preds.write.parquet(os.path.join(d, f"{name}.parquet"))
    got = {r.run_name for r in FS.scan_predictions(spark, os.path.join(d, "*.parquet"))
           .select("run_name").distinct().collect()}
    assert got == {"x_s1-none_s2-lora", "y_s1-none_s2-full"}


def test_predictions_csv_all_quoted(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="quarry-pcsv-"), "out")
    df = spark.createDataFrame([('he said "x"', "A", "B", "s")],
                               "question string, gold_label string, pred_label string, specialty string")
    FS.write_predictions_csv(df, d)
    text = "".join(open(os.path.join(d, f), encoding="utf-8").read() for f in sorted(os.listdir(d))
                   if f.endswith(".csv"))
    assert '"he said ""x""","A","B","False","s"' in text


def test_eval_results_json(spark):
    from quarry.operators import scoring as R
    d = os.path.join(tempfile.mkdtemp(prefix="quarry-json-"), "res")
    preds = spark.createDataFrame([("1", "A", "A", "طب"), ("2", "B", "A", "طب")],
                                  "question_id string, gold_label string, pred_label string, specialty string")
    FS.write_eval_results(R.eval_results(preds), d)
    line = [ln for f in os.listdir(d) if f.endswith(".json") for ln in open(os.path.join(d, f), encoding="utf-8")][0]
    obj = json.loads(line)
    assert obj["total_samples"] == 2 and obj["per_specialty_scores"]["طب"]["count"] == 2


def test_checkpoint_metadata_scan(spark):
    root = tempfile.mkdtemp(prefix="quarry-outputs-")

    def mk(entry, files):
        s1 = os.path.join(root, entry, "stage1")
        os.makedirs(s1)
        for f, content in files.items():
            _write(s1, f, content)

    mk("exp01_alpha_lora", {"training_args.json": json.dumps({"model_name": "org/alpha-8B", "method": "lora"}),
                            "adapter_config.json": "{}"})
    mk("exp02_alpha_lora_copy", {"adapter_config.json": "{}"})                # same key, later name
    mk("exp03_beta_x", {"training_args.json": "{not json", "model.safetensors": ""})  # bad JSON -> hints
    mk("exp04_unknown", {"model.safetensors": ""})                            # unidentifiable
    got = {(r.model_name, r.method): r.stage1_dir for r in FS.scan_checkpoint_metadata(
        spark, root, {"alpha": "org/alpha-8B", "beta": "org/beta-8B"}).collect()}
    assert set(got) == {("org/alpha-8B", "lora"), ("org/beta-8B", "full")}
    assert got[("org/alpha-8B", "lora")].endswith("exp01_alpha_lora/stage1")


def test_metric_log_append_and_perplexity_table(spark):
    d = tempfile.mkdtemp(prefix="quarry-log-")
    rows = spark.createDataFrame([("r", "stage1", "val_loss", 1, 1.234567)],
                                 "run_name string, stage string, metric string, step long, value double")
    FS.append_metric_log(rows, os.path.join(d, "log"))
    FS.append_metric_log(rows, os.path.join(d, "log"))
    back = FS.read_metric_log(spark, os.path.join(d, "log"))
    assert [tuple(r) for r in back.collect()] == [("r", "stage1", "val_loss", 1, 1.2346)]  # a retry changes nothing
    more = spark.createDataFrame([("r", "stage1", "val_loss", 2, 0.5), ("r", "stage1", "val_loss", 1, 0.75), ("s", "stage2", "x", 0, 1.0)],
                                 rows.schema)
    FS.append_metric_log(more, os.path.join(d, "log"))
    FS.append_metric_log(rows.limit(0), os.path.join(d, "log"))
    assert sorted(tuple(r) for r in FS.read_metric_log(spark, os.path.join(d, "log")).collect()) == [
        ("r", "stage1", "val_loss", 1, 0.75), ("r", "stage1", "val_loss", 2, 0.5), ("s", "stage2", "x", 0, 1.0)]
    ppl = spark.createDataFrame([("m", "lora", 20.12, 9.6, "/x")], FS.PERPLEXITY_SCHEMA)
    FS.write_perplexity_table(ppl, os.path.join(d, "ppl"))
    assert FS.read_perplexity_table(spark, os.path.join(d, "ppl")).first().ppl_after == 9.6
    assert FS.scan_run_log(spark, os.path.join(d, "missing")).count() == 0


def test_breakdowns_and_sft_export(spark):
    from quarry.operators import cleaning as C
    from quarry.operators import examples as E
    from quarry.plans.cleaning import loaded_mcq
    d = tempfile.mkdtemp(prefix="quarry-bd-")
    FS.write_breakdowns(X.predictions(spark, SF001), os.path.join(d, "bd"))
    cw = spark.read.option("header", True).csv(os.path.join(d, "bd", "classwise"))
    assert cw.count() == 60 and "run_name" in cw.columns
    lvl = spark.read.option("header", True).csv(os.path.join(d, "bd", "acc_by_level"))
    assert lvl.columns == ["run_name", "Y1", "Y2", "Y3", "Y4", "Y5"]
    ex = E.split_exact(E.build_examples(C.clean_mcq(loaded_mcq(spark, SF001)), "mcq", keep=("question_id",)),
                       "question_id", 0.05)
    meta = FS.write_sft_corpus(ex, os.path.join(d, "sft")).first()
    assert (meta.train_samples, meta.val_samples) == (361, 19)
    back = spark.read.json(os.path.join(d, "sft", "data"))
    assert back.where("split = 'val'").count() == 19


def test_statistics_table_csv(spark):
    from quarry.operators import inference as I
    preds = X.predictions(spark, SF001)
    config = I.bootstrap_ci(preds, n_boot=300)
    seeds = M.seed_aggregates(M.run_metrics(preds))
    stats = I.statistics_table(config, I.contrast_report(preds, X.models(spark), n_boot=300), seeds)
    d = os.path.join(tempfile.mkdtemp(prefix="quarry-stats-"), "statistics")
    FS.write_statistics(stats, d)
    back = spark.read.option("header", True).csv(d)
    kinds = {r.kind: r["count"] for r in back.groupBy("kind").count().collect()}
    assert kinds == {"config": 12, "contrast": 3, "seed_agg": 1}
    assert set(back.columns) >= {"kind", "run_name", "acc_ci_lo", "mcnemar_p", "f1_delta_p", "seeds", "acc_std"}
    row = back.where("kind = 'seed_agg'").first()
    assert row.seeds == "42,1337,2024" and row.mcnemar_p is None


def test_run_log_json_and_metric_rows(spark):
    d = tempfile.mkdtemp(prefix="quarry-runlog-")
    p = _write(d, "runs.json", json.dumps({"name": "r1", "state": "finished", "accuracy": 0.5, "macro_f1": 0.4,
                                           "tags": ["revision"]}) + "\n")
    r = FS.scan_run_log(spark, p).first()
    assert (r.name, r.state, r.accuracy, list(r.tags)) == ("r1", "finished", 0.5, ["revision"])
    per = spark.createDataFrame([("x", 0.123456, 0.5, 3)], "specialty string, accuracy double, macro_f1 double, count long")
    rows = {r.metric: r.value for r in FS.per_group_metric_rows(per, "run", "eval").collect()}
    assert rows == {"eval/x/accuracy": 0.123456, "eval/x/macro_f1": 0.5, "eval/x/count": 3.0}


def test_run_log_folder_by_address_and_errors(spark):
    d = tempfile.mkdtemp(prefix="quarry-runlog-")
    runs = [{"name": f"r{i}", "state": "finished", "accuracy": 0.5, "macro_f1": 0.4, "tags": ["x"]} for i in range(3)]
    _write(d, "a.json", "".join(json.dumps(r) + "\n" for r in runs[:2]))
    _write(d, "b.json", json.dumps(runs[2]) + "\n")
    for path in (d, f"file://{d}"):
        log = FS.scan_run_log(spark, path)
        assert sorted(r.name for r in log.collect()) == ["r0", "r1", "r2"] and log.first().state == "finished"
    parquet = os.path.join(d, "as_parquet")
    FS.scan_run_log(spark, d).write.parquet(parquet)
    assert FS.scan_run_log(spark, f"file://{parquet}").count() == 3
    for gone in (f"{d}/missing", f"file://{d}/missing", f"file://{d}/missing.json", f"file://{tempfile.mkdtemp()}"):
        assert FS.scan_run_log(spark, gone).columns == log.columns and FS.scan_run_log(spark, gone).count() == 0
    broken = tempfile.mkdtemp(prefix="quarry-runlog-")
    _write(broken, "runs.parquet", "not parquet")
    with pytest.raises(Exception, match="runs.parquet"):
        FS.scan_run_log(spark, broken).count()
    _write(broken, "runs.json", json.dumps(runs[0]) + "\n")
    with pytest.raises(ValueError, match="apart"):
        FS.scan_run_log(spark, broken)


def test_checkpoint_metadata_of_folders_with_odd_names(spark):
    root = tempfile.mkdtemp(prefix="quarry-odd-")
    names = ["my run2", "résumé %20 a+b", "plain"]
    for i, name in enumerate(names):
        os.makedirs(os.path.join(root, name, "stage1"))
        with open(os.path.join(root, name, "stage1", "training_args.json"), "w") as f:
            f.write('{"model_name": "org/m%d", "method": "lora"}' % i)
    got = {r.model_name: (r.method, r.stage1_dir) for r in FS.scan_checkpoint_metadata(spark, root, {"run2": "hint"}).collect()}
    assert got == {f"org/m{i}": ("lora", f"{root}/{name}/stage1") for i, name in enumerate(names)}
