"""File sources and sinks.

* CSV: everything is read as STRING and the whole pandas list of
  missing-value markers is nulled afterwards (Spark's ``nullValue`` takes one
  string). ``read_csv_strict`` handles quoted cells with embedded newlines;
  ``read_csv_tolerant`` treats quotes as ordinary characters, pads short rows
  with nulls and drops over-long ones (never DROPMALFORMED, which would also
  drop short rows); ``read_csv_two_pass`` decides per file: strict unless the
  file has an over-long record or ends inside a quoted cell.
* Prediction files: one table partitioned by ``run_name`` (or one file per
  run, the run name taken from the file stem via ``_metadata.file_path``).
  Writes use dynamic partition overwrite so rewriting one run leaves the
  others in place.
* Every scratch location comes from ``spark.checkpoint.dir`` (a shared
  folder on a cluster), never a machine-local temporary folder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quarry.functions.text import na_to_null
from quarry.operators import metrics as M
from quarry.session import checkpoint_dir, cut_lineage

PREDICTION_COLUMNS = ("question_id", "gold_label", "pred_label", "logit_A", "logit_B", "logit_C", "logit_D",
                      "logit_E", "specialty", "umbrella_specialty", "level")
CORRUPT = "_corrupt_record"
EXTRA = "_extra_field"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


# --------------------------------------------------------------------------
# CSV (A1-A3)
# --------------------------------------------------------------------------

def _header(spark: SparkSession, path: str | list[str], quote: str) -> list[str]:
    return spark.read.option("header", True).option("quote", quote).option("escape", '"').csv(path).columns


def _null_markers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in cols])


def _schema(cols: Sequence[str]) -> str:
    return ", ".join(f"`{c}` string" for c in [*cols, EXTRA, CORRUPT])


def read_csv_strict(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Quoted CSV (embedded newlines, doubled quotes), all columns STRING."""
    cols = _header(spark, path, '"')
    df = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
          .option("mode", "PERMISSIVE").option("nullValue", "\u0001").option("columnNameOfCorruptRecord", CORRUPT)
          .schema(_schema(cols)).csv(path))
    return df


def read_csv_tolerant(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Quotes are ordinary characters; short rows padded with null; rows with
    more fields than the header dropped; bad UTF-8 replaced."""
    cols = _header(spark, path, "")
    df = (spark.read.option("header", True).option("quote", "").option("mode", "PERMISSIVE")
          .option("nullValue", "\u0001").option("encoding", "UTF-8")
          .option("columnNameOfCorruptRecord", CORRUPT).schema(_schema(cols)).csv(path))
    # A record has too many fields when the extra column caught one.
    ok = df.where(F.col(EXTRA).isNull())
    return _null_markers(ok, cols)


def ends_in_quotes(line: str, inside: bool) -> bool:
    """Whether a quoted cell is still open after a line. Only a quote at the
    start of a cell opens one; elsewhere in an unquoted cell it is a character."""
    i = 0
    while True:
        if inside:
            i = line.find('"', i) + 1
            if i == 0:
                return True
            if line[i:i + 1] == '"':  # doubled: a character of the cell
                i += 1
                continue
            inside = False
        elif line[i:i + 1] == '"':
            inside, i = True, i + 1
            continue
        i = line.find(",", i) + 1
        if i == 0:
            return False


def _open_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per file split: is a cell open at its end if none, or one, is open at its start."""
    at, state = None, (False, True)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [at[0]], "start": pa.array([at[1]], pa.int64()),
                                           "if_closed": [state[0]], "if_open": [state[1]]})

    for b in batches:
        for file, start, line in zip(*[b.column(c).to_pylist() for c in ("file", "start", "value")], strict=True):
            if (file, start) != at:
                if at is not None:
                    yield row()
                at, state = (file, start), (False, True)
            if '"' in line:
                state = (ends_in_quotes(line, state[0]), ends_in_quotes(line, state[1]))
    if at is not None:
        yield row()


def csv_problems(spark: SparkSession, path: str) -> DataFrame:
    """One row per file that strict parsing fails on: (file, over_long,
    unterminated). Splits of a file are scanned independently, each for both
    states it may start in; a file's few splits are then chained in order."""
    over = read_csv_strict(spark, path).where(F.col(EXTRA).isNotNull()) \
        .groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("over_long"))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    splits = lines.mapInArrow(_open_after, "file string, start long, if_closed boolean, if_open boolean")
    chained = F.aggregate(F.array_sort(F.collect_list(F.struct("start", "if_closed", "if_open"))), F.lit(False),
                          lambda open_, s: F.when(open_, s["if_open"]).otherwise(s["if_closed"]))
    unclosed = splits.groupBy("file").agg(chained.alias("unterminated")).where("unterminated")
    return over.join(unclosed, "file", "full").select(
        "file", F.coalesce("over_long", F.lit(0)).alias("over_long"),
        F.coalesce("unterminated", F.lit(False)).alias("unterminated"))


def read_csv_two_pass(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Each file read strictly unless that would fail (over-long record or an
    unterminated quote), then tolerantly. Returns (rows, mode): ``strict``,
    ``tolerant`` or ``mixed``. The driver holds the names of the failing files,
    as it does the listing of the folder."""
    bad = {r["file"] for r in csv_problems(spark, path).select("file").toLocalIterator()}
    strict = read_csv_strict(spark, path)
    cols = [c for c in strict.columns if c not in (EXTRA, CORRUPT)]
    if not bad:
        return _null_markers(strict, cols), "strict"
    files = [r["file"] for r in spark.read.format("binaryFile").load(path)
             .select(F.col("_metadata.file_path").alias("file")).toLocalIterator()]
    good = [unquote(f) for f in files if f not in bad]
    rows = read_csv_tolerant(spark, sorted(map(unquote, bad)))
    if not good:
        return rows, "tolerant"
    return _null_markers(read_csv_strict(spark, good), cols).unionByName(rows), "mixed"


def write_csv(df: DataFrame, path: str, quote_all: bool = False, single_file: bool = False) -> None:
    w = df.coalesce(1) if single_file else df
    (w.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("quoteAll", quote_all).option("emptyValue", "").option("nullValue", "").csv(path))


# --------------------------------------------------------------------------
# Predictions
# --------------------------------------------------------------------------

def write_predictions(preds: DataFrame, path: str, extra: Sequence[str] = ()) -> None:
    """Partitioned by run_name, fixed column order (columns present only), then
    ``extra`` ones; dynamic overwrite replaces only the runs being written."""
    cols = [*[c for c in PREDICTION_COLUMNS if c in preds.columns], *extra]
    (preds.select("run_name", *cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_name").parquet(path))


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    """All runs of a prediction folder: a ``run_name=`` partitioned table, or
    one ``<run_name>.parquet`` file per run."""
    df = spark.read.parquet(path)
    if "run_name" in df.columns:
        return df
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.parquet/?(part-[^/]*)?$", 1)
    return df.select(stem.alias("run_name"), "*")


def write_predictions_csv(preds: DataFrame, path: str) -> None:
    """question, reference, prediction, correct, specialty -- every field quoted."""
    out = preds.select(F.col("question").cast("string"), F.col("gold_label").alias("reference"),
                       F.col("pred_label").alias("prediction"),
                       F.when(F.col("gold_label") == F.col("pred_label"), "True").otherwise("False").alias("correct"),
                       F.col("specialty").cast("string"))
    write_csv(out, path, quote_all=True)


# --------------------------------------------------------------------------
# Results, statistics, breakdowns, perplexity
# --------------------------------------------------------------------------

EVAL_RESULTS_SCHEMA = ("run_name string, accuracy double, macro_f1 double, total_samples long, per_specialty_scores "
                       "map<string, struct<accuracy: double, macro_f1: double, count: long>>, answer_token_ids map<string, long>")


def write_eval_results(results: DataFrame, path: str) -> None:
    """Summary rows with the nested per-group map as JSON (non-ASCII kept)."""
    results.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_eval_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_RESULTS_SCHEMA).json(path)


# Stands for an empty text while a typed CSV file is read.
_EMPTY = "\u0001"


def write_typed_csv(df: DataFrame, path: str, schema: str) -> None:
    """Rows of several kinds under one declared schema: columns a kind lacks are
    null. Null is a bare empty cell, an empty text a quoted one, NaN is written
    out, so all three come back from ``read_typed_csv``. A column outside the
    schema is an error. Not kept: a text that is the one character U+0001."""
    declared = _parsed(df.sparkSession, schema)
    odd = set(df.columns) - set(declared.names)
    if odd:
        raise ValueError(f"columns outside the declared schema: {sorted(odd)}")
    cells = [(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared]
    (df.select(*cells).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("nullValue", "").option("emptyValue", '""').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def read_typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_typed_csv`` wrote; a header that differs from the schema is an error."""
    declared = _parsed(spark, schema)
    rows = (spark.read.schema(declared).option("header", True).option("enforceSchema", False).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", _EMPTY)
            .option("mode", "FAILFAST").csv(path))
    return rows.select(*[F.when(F.col(f"`{f.name}`") == _EMPTY, "").otherwise(F.col(f"`{f.name}`")).alias(f.name)
                         if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in declared])


def _parsed(spark: SparkSession, schema: str) -> StructType:
    return spark.createDataFrame([], schema).schema


# The columns of the statistics report: configurations, then contrasts, then seeds.
STATISTICS_SCHEMA = (
    "kind string, run_name string, accuracy double, acc_ci_lo double, acc_ci_hi double, macro_f1 double, f1_ci_lo double, "
    "f1_ci_hi double, n long, model string, stage1 string, run_full string, run_lora string, mcnemar_b long, mcnemar_c long, "
    "mcnemar_stat double, mcnemar_p double, mcnemar_kind string, f1_delta double, f1_delta_ci_lo double, f1_delta_ci_hi double, "
    "f1_delta_p double, acc_delta double, acc_delta_ci_lo double, acc_delta_ci_hi double, seeds string, n_seeds long, "
    "acc_std double, f1_std double")


def write_statistics(stats: DataFrame, path: str) -> None:
    write_typed_csv(stats, path, STATISTICS_SCHEMA)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    return read_typed_csv(spark, path, STATISTICS_SCHEMA)


def write_breakdowns(preds: DataFrame, path: str) -> None:
    """Per-run class-wise report and confusion matrix (partitioned by run),
    plus cross-run pivots: accuracy by umbrella specialty, level, gold label
    and F1 by letter. One job per table, not one file write per run."""
    M.classwise_report(preds).write.mode("overwrite").partitionBy("run_name").option("header", True).csv(
        os.path.join(path, "classwise"))
    M.confusion_matrix(preds).write.mode("overwrite").partitionBy("run_name").option("header", True).csv(
        os.path.join(path, "confusion"))
    tables = {
        "acc_by_specialty": M.accuracy_pivot(preds, "umbrella_specialty", []),
        "acc_by_level": M.accuracy_pivot(preds, "level", M.LEVELS),
        "acc_by_gold_label": M.accuracy_pivot(preds, "gold_label", M.LETTERS),
        "f1_by_letter": M.f1_pivot(preds),
    }
    for name, t in tables.items():
        write_csv(t, os.path.join(path, name))


PERPLEXITY_SCHEMA = "model string, stage1_method string, ppl_before double, ppl_after double, checkpoint string"


def write_perplexity_table(df: DataFrame, path: str) -> None:
    write_csv(df.select("model", "stage1_method", "ppl_before", "ppl_after", "checkpoint"), path)


def read_perplexity_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(PERPLEXITY_SCHEMA).csv(path)


# --------------------------------------------------------------------------
# Checkpoint metadata, run log, metric log
# --------------------------------------------------------------------------

META_SCHEMA = ("model_name string, method string, stage string, num_epochs long, config_path string, "
               "train_samples long, val_samples long, _corrupt_record string")


def scan_checkpoint_metadata(spark: SparkSession, outputs: str, name_hints: Mapping[str, str]) -> DataFrame:
    """Unique stage-1 checkpoints as (model_name, method, stage1_dir).

    ``<outputs>/<run>/stage1/training_args.json`` supplies model and method
    (unreadable JSON tolerated). Where either is missing, both are inferred:
    method from an adapter marker file, model from a keyword of the folder
    name (``name_hints``: keyword -> model id); unidentified folders drop out.
    The first folder per (model, method) in name order wins."""
    glob = os.path.join(outputs, "*", "stage1")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", False)
             .load(os.path.join(glob, "*")).select("path"))
    dirs = files.select(F.regexp_extract("path", r"^(.*)/stage1/[^/]+$", 1).alias("run_dir"),
                        F.regexp_extract("path", r"/stage1/([^/]+)$", 1).alias("file"))
    per_dir = dirs.groupBy("run_dir").agg(
        F.max(F.when(F.col("file") == "adapter_config.json", True).otherwise(False)).alias("adapter"),
        F.max(F.when(F.col("file") == "training_args.json", True).otherwise(False)).alias("has_meta"))
    meta_path = os.path.join(glob, "training_args.json")
    try:
        # ``_metadata.file_path`` is an encoded URI, the path of binaryFile is not.
        plain = F.call_function("url_decode", F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        meta = (spark.read.schema(META_SCHEMA).option("mode", "PERMISSIVE").option("multiLine", True)
                .json(meta_path).select(F.regexp_extract(plain, r"^(?:file:(?://)?)?(.*)/stage1/[^/]+$", 1).alias("meta_dir"),
                                        "model_name", "method"))
    except AnalysisException as e:  # no metadata files at all; any other failure is raised
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        meta = spark.createDataFrame([], "meta_dir string, model_name string, method string")
    d = per_dir.withColumn("meta_dir", F.regexp_replace("run_dir", "^file:(//)?", ""))
    j = d.join(meta, "meta_dir", "left")
    entry = F.regexp_extract("meta_dir", r"([^/]+)$", 1)
    hint = F.lit(None).cast("string")
    for key, model in reversed(list(name_hints.items())):
        hint = F.when(F.lower(entry).contains(key.lower()), F.lit(model)).otherwise(hint)
    complete = F.col("model_name").isNotNull() & F.col("method").isNotNull()
    model = F.when(complete, F.col("model_name")).otherwise(hint)
    method = F.when(complete, F.col("method")).otherwise(F.when(F.col("adapter"), "lora").otherwise("full"))
    found = j.select(entry.alias("entry"), model.alias("model_name"), method.alias("method"),
                     F.concat(F.col("meta_dir"), F.lit("/stage1")).alias("stage1_dir")).where(
        F.col("model_name").isNotNull())
    return found.groupBy("model_name", "method").agg(
        F.min_by("stage1_dir", "entry").alias("stage1_dir"))


RUN_LOG_SCHEMA = "name string, state string, accuracy double, macro_f1 double, tags array<string>"


def scan_run_log(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Exported tracker runs (parquet or JSON); empty when there is no such path
    or no file in it. Every other failure is raised: a log that cannot be read is
    not an empty one. The format is ``fmt``, that of a path ending in .json, or is
    chosen from Spark's listing of the path, which may be on any store that executors reach."""
    fmt = fmt or ("json" if path.endswith(".json") else None)
    try:
        if fmt is None:
            name = F.regexp_extract("path", r"([^/]*)$", 1)
            n = spark.read.format("binaryFile").load(path).agg(
                F.count(F.lit(1)).alias("files"), F.count_if(name.rlike(r"\.json(\.\w+)?$")).alias("json"),
                F.count_if(name.endswith(".parquet")).alias("parquet")).first()
            if n["json"] and n["parquet"]:
                raise ValueError(f"run log {path} holds JSON and parquet files: read them apart")
            if not n["files"]:
                return spark.createDataFrame([], RUN_LOG_SCHEMA)
            fmt = "json" if n["json"] else "parquet"
        return spark.read.schema(RUN_LOG_SCHEMA).json(path) if fmt == "json" else spark.read.format(fmt).load(path)
    except AnalysisException as e:  # the tracker export may be missing
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUN_LOG_SCHEMA)


METRIC_LOG_SCHEMA = "run_name string, stage string, metric string, step long, value double"


def append_metric_log(rows: DataFrame, path: str) -> None:
    """Add long metric rows (values rounded to 4 dp) to a parquet log partitioned
    by run and stage. A row is known by (run, stage, metric, step): writing it
    again replaces it, so a retried append changes nothing. Only the runs and
    stages of ``rows`` are rewritten. One writer per run and stage at a time."""
    key = ["run_name", "stage", "metric", "step"]
    new = rows.select("run_name", "stage", "metric", F.col("step").cast("long"), F.round(F.col("value").cast("double"), 4).alias("value")
                      ).groupBy(*key).agg(F.max("value").alias("value"))  # equal keys in one call: the largest
    new = cut_lineage(new)
    try:
        old = read_metric_log(rows.sparkSession, path)
        old = old.join(new.select("run_name", "stage").distinct(), ["run_name", "stage"], "left_semi")
        new = cut_lineage(old.join(new, key, "left_anti").unionByName(new))
    except AnalysisException as e:  # the first rows of a log
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    # One file per run and stage.
    new.repartition("run_name", "stage").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "run_name", "stage").parquet(path)


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_LOG_SCHEMA).parquet(path).select("run_name", "stage", "metric", "step", "value")


def dataset_size_rows(overview: DataFrame, run_name: str, stage: str = "data") -> DataFrame:
    """Metric rows of a dataset overview: samples of every split, and removed
    rows and their share where a split was cleaned."""
    name = F.concat(F.lit("data/"), F.col("dataset"), F.lit("/"))
    rows = F.array(*[F.struct(F.concat(name, *m).alias("metric"), F.col(v).cast("double").alias("value")) for m, v in (
        ((F.col("split"), F.lit("/samples")), "samples"), ((F.lit("samples_removed"),), "removed"),
        ((F.lit("removal_pct"),), "removal_pct"))])
    return overview.select(F.inline(rows)).where("value is not null").select(
        F.lit(run_name).alias("run_name"), F.lit(stage).alias("stage"), "metric", F.lit(0).cast("long").alias("step"), "value")


def loss_rows(losses: DataFrame) -> DataFrame:
    """Metric rows of (run_name, stage, epoch, val_loss), epochs from 1: the loss
    and the epoch under the name of the stage, at the step of the epoch."""
    pairs = F.array(F.struct(F.lit("val_loss").alias("k"), F.col("val_loss").cast("double").alias("value")),
                    F.struct(F.lit("epoch").alias("k"), F.col("epoch").cast("double").alias("value")))
    return losses.select("run_name", "stage", F.col("epoch").cast("long").alias("step"), F.inline(pairs)).select(
        "run_name", "stage", F.concat_ws("/", "stage", "k").alias("metric"), "step", "value")


def per_group_metric_rows(per_group: DataFrame, run_name: str, stage: str, group: str = "specialty") -> DataFrame:
    """Per-group accuracy / macro F1 / count as long metric rows."""
    m = F.array(*[F.struct(F.lit(f"{k}").alias("k"), F.col(k).cast("double").alias("v"))
                  for k in ("accuracy", "macro_f1", "count")])
    return per_group.select(F.lit(run_name).alias("run_name"), F.lit(stage).alias("stage"), F.col(group),
                            F.inline(m)).select(
        "run_name", "stage", F.concat(F.lit("eval/"), F.col(group), F.lit("/"), F.col("k")).alias("metric"),
        F.lit(0).cast("long").alias("step"), F.col("v").alias("value"))


# --------------------------------------------------------------------------
# Training corpus export
# --------------------------------------------------------------------------

SFT_META = ("train_samples", "val_samples")


def write_sft_corpus(examples: DataFrame, path: str, split: str = "split", facts: Mapping[str, object] | None = None) -> DataFrame:
    """Write rendered examples as JSON-lines shards per split
    (``<path>/data/split=train|val``) and one metadata row (``<path>/_meta``): the
    split sizes, then ``facts`` (model, method, epochs ...). The sizes are observed
    on the write itself, so the examples are worked out and read once. Returns
    the metadata row."""
    clash = set(SFT_META) & set(facts or ())
    if clash:
        raise ValueError(f"sizes are counted, not given: {sorted(clash)}")
    sizes = Observation()
    examples.observe(sizes, *[F.count_if(F.col(split) == side.removesuffix("_samples")).alias(side) for side in SFT_META]).write.mode(
        "overwrite").partitionBy(split).json(os.path.join(path, "data"))
    seen = sizes.get
    known = [F.lit(None).cast("string").alias(k) if v is None else F.lit(v).alias(k) for k, v in (facts or {}).items()]
    meta = examples.sparkSession.range(1).select(*[F.lit(seen[side]).cast("long").alias(side) for side in SFT_META], *known)
    meta.coalesce(1).write.mode("overwrite").json(os.path.join(path, "_meta"))
    return meta


def read_sft_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The examples of an export (``schema`` with the split column), with the size of
    their split in the metadata as ``split_samples``."""
    meta = spark.read.schema(", ".join(f"{side} long" for side in SFT_META)).json(os.path.join(path, "_meta"))
    train, val = (meta.agg(F.max(side)).scalar() for side in SFT_META)
    return spark.read.schema(schema).json(os.path.join(path, "data")).withColumn(
        "split_samples", F.when(F.col("split") == "train", train).otherwise(val))
