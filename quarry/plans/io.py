"""Registered queries: file sources and sinks as round trips.

Each query writes a table derived from the driver's data into the shared
scratch folder (under ``spark.checkpoint.dir``), reads it back through the
source under test, and runs an operator whose result the oracle already
knows from the parquet tables -- so the file path is checked end to end.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from quarry.operators import cleaning as C
from quarry.operators import metrics as M
from quarry.plans import cleaning as PC
from quarry.plans import evaluation as PE
from quarry.plans import sqlgen as S
from quarry.plans import statistics as PS
from quarry.sources import files as FS
from quarry.sources import fixtures as X
from quarry.sources import ordered as O
from quarry.sources.tables import table

# Raw CSV headers of the multiple-choice corpus, mapped from the fixture.
CSV_HEADERS = {
    "question_number": "Question Number", "question": "Question", "option_a": "Option A", "option_b": "Option B",
    "option_c": "Option C", "option_d": "Option D", "option_e": "Option E", "answer": "Correct Answer",
    "specialty": "Medical Specialty", "umbrella_specialty": "umbrella_specialty", "level": "Level",
}


def _mcq_csv(spark, sf):
    path = FS.scratch_path(spark, "mcq-csv")
    raw = X.mcq_raw(spark, sf)
    FS.write_csv(raw.select(*[F.col(k).alias(v) for k, v in CSV_HEADERS.items()]), path, quote_all=True)
    rows, _mode = FS.read_csv_two_pass(spark, path)
    return rows


def _csv_counters(spark, sf):
    rows = _mcq_csv(spark, sf).withColumn("row_idx", F.col(CSV_HEADERS["question_number"]).cast("long"))
    return C.clean_mcq_with_counters(C.load_mcq(rows, order="row_idx"))


def _csv_stray_quotes(spark, sf):
    """Cells that start with a lone quote, and over-long records: the files are read tolerantly."""
    path = FS.scratch_path(spark, "stray-csv")
    key = F.col("o_orderkey").cast("string")
    line = F.concat_ws(",", key, F.concat(F.lit('"'), "o_orderpriority"), "o_orderstatus",
                       F.when(F.col("o_orderkey") % 7 == 0, F.lit("surplus")))
    # One column of whole lines: the writer neither quotes nor escapes.
    table(spark, sf, "orders").select(line.alias("id,priority,status")).write.option("header", True) \
        .option("sep", "\u0001").option("quote", "").csv(path)
    return FS.read_csv_two_pass(spark, path)[0]


def _predictions_roundtrip(spark, sf):
    path = FS.scratch_path(spark, "predictions")
    FS.write_predictions(X.predictions(spark, sf), path)
    return M.run_metrics(FS.scan_predictions(spark, path))


def _statistics_csv(spark, sf):
    path = FS.scratch_path(spark, "confusion-csv")
    FS.write_csv(M.confusion_matrix(X.predictions(spark, sf)), path)
    back = spark.read.option("header", True).schema(
        "run_name string, gold_label string, pred_label string, n long").csv(path)
    return back


def _csv_quoted(spark, sf):
    """Whole texts with line feeds, written as several files and read by file splits, with their input position."""
    path = FS.scratch_path(spark, "quoted-csv")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    # At least four files; as many as the input has splits, so a task's share does not grow with the table.
    parts = max(4, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), docs.rdd.getNumPartitions())
    docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").write.option("header", True).option("quote", '"').option(
        "escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return O.read_csv_quoted(spark, path, "row_idx")


def _first_rows(spark, sf):
    """The first document of every source, in the order of the stored file."""
    rows = O.read_parquet_ordered(spark, f"{sf.rstrip('/')}/documents.parquet").select("row_idx", "doc_id", "source")
    return O.first_by_position(rows, "source")


def _metric_log(spark, sf):
    """Dataset sizes and losses logged, the losses twice as by a retried job, and read back."""
    path = FS.scratch_path(spark, "metric-log")
    losses = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("run-"), "l_returnflag").alias("run_name"), F.lit("stage1").alias("stage"),
                                                  F.col("l_linenumber").alias("epoch")).agg(
        (F.sum(F.col("l_quantity").cast("long")) / F.count(F.lit(1))).alias("val_loss"))
    FS.append_metric_log(FS.dataset_size_rows(PC.QUERIES["dataset_overview"](spark, sf), "data-card"), path)
    for _ in range(2):
        FS.append_metric_log(FS.loss_rows(losses), path)
    return FS.read_metric_log(spark, path)


# What the report holds besides resampled bounds and the chi-square tail.
EXACT_STATISTICS = ("kind", "run_name", "n", "model", "stage1", "run_full", "run_lora", "mcnemar_b", "mcnemar_c", "mcnemar_kind",
                    "seeds", "n_seeds")
ROUNDED_STATISTICS = ("accuracy", "macro_f1", "mcnemar_stat", "f1_delta", "acc_delta", "acc_std", "f1_std")


def _statistics_report(spark, sf):
    """The report of all three kinds, written and read back: its exact columns and
    whether every interval holds its point."""
    path = FS.scratch_path(spark, "statistics")
    FS.write_statistics(PS.QUERIES["statistics_table"](spark, sf), path)
    inside = F.lit(True)
    for point, ci in (("accuracy", "acc_ci"), ("macro_f1", "f1_ci"), ("f1_delta", "f1_delta_ci"), ("acc_delta", "acc_delta_ci")):
        inside = inside & F.coalesce(F.col(point).between(F.col(f"{ci}_lo"), F.col(f"{ci}_hi")), F.lit(True))
    return FS.read_statistics(spark, path).select(*EXACT_STATISTICS, *[F.round(c, 9).alias(c) for c in ROUNDED_STATISTICS],
                                                  inside.alias("points_inside"))


QUERIES = {
    "statistics_round_trip": _statistics_report,
    "csv_quoted_splits": _csv_quoted,
    "first_rows_in_order": _first_rows,
    "metric_log_round_trip": _metric_log,
    "csv_two_pass_counters": _csv_counters,
    "csv_two_pass_tolerant": _csv_stray_quotes,
    "scan_predictions": _predictions_roundtrip,
    "write_statistics_csv": _statistics_csv,
}

ORACLE = {
    "csv_quoted_splits": """select cast(doc_id as varchar) as doc_id, lang, nullif(text, '') as text,
  row_number() over (order by doc_id) - 1 as row_idx from documents""",
    "first_rows_in_order": """with r as (select row_number() over () - 1 as row_idx, doc_id, source from documents)
select row_idx, doc_id, source from r qualify row_number() over (partition by source order by row_idx) = 1""",
    "metric_log_round_trip": f"""with o as ({PC.ORACLE["dataset_overview"]}),
l as (select 'run-' || l_returnflag as run_name, l_linenumber as epoch,
        sum(cast(l_quantity as bigint))::double / count(*) as val_loss from lineitem group by all)
select 'data-card' as run_name, 'data' as stage, 'data/' || dataset || '/' || split || '/samples' as metric, 0::bigint as step,
  samples::double as value from o
union all select 'data-card', 'data', 'data/' || dataset || '/samples_removed', 0, removed from o where removed is not null
union all select 'data-card', 'data', 'data/' || dataset || '/removal_pct', 0, removal_pct from o where removal_pct is not null
union all select run_name, 'stage1', 'stage1/val_loss', epoch, round(val_loss, 4) from l
union all select run_name, 'stage1', 'stage1/epoch', epoch, epoch from l""",
    "csv_two_pass_counters": PC.ORACLE["clean_mcq_with_counters"],
    "csv_two_pass_tolerant": """select cast(o_orderkey as varchar) as id, '"' || o_orderpriority as priority,
  o_orderstatus as status from orders where o_orderkey % 7 <> 0""",
    "scan_predictions": PE.ORACLE["run_metrics"],
    "write_statistics_csv": PE.ORACLE["confusion_matrix"],
}

_SIDE = "select contrast, gold_a as gold_label, pred_{s} as pred_label from paired"
ORACLE["statistics_round_trip"] = X.with_fixtures(f"""with {PS.PAIRS.strip()},
side_a as ({_SIDE.format(s='a')}), side_b as ({_SIDE.format(s='b')}),
{S.wide_cte('side_a', ['contrast'], 'wide_a')}, {S.wide_cte('side_b', ['contrast'], 'wide_b')},
a as (select contrast, {S.accuracy()} as acc, {S.macro_fixed()} as f1 from wide_a),
b as (select contrast, {S.accuracy()} as acc, {S.macro_fixed()} as f1 from wide_b),
tests as ({PS.ORACLE["mcnemar"]}), config as ({PE.ORACLE["run_metrics"]}), seeds as ({PE.ORACLE["seed_aggregates"]})
select 'config' as kind, run_name, n, round(accuracy, 9) as accuracy, round(macro_f1, 9) as macro_f1, true as points_inside
from config
union all by name
select 'contrast' as kind, contrast as run_name, tests.n, contrasts.model, contrasts.stage1, run_full, run_lora, mcnemar_b,
  mcnemar_c, mcnemar_kind, round(mcnemar_stat, 9) as mcnemar_stat, round(a.f1 - b.f1, 9) as f1_delta,
  round(a.acc - b.acc, 9) as acc_delta, true as points_inside
from tests join contrasts using (contrast) join a using (contrast) join b using (contrast)
union all by name
select *, true as points_inside from seeds""", "predictions", "models")
