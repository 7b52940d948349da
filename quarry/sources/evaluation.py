"""An evaluation run on disk: one scoring, several sinks.

The scored rows are written once, as the run's partition of the prediction
table. Metrics, the JSON summary and the CSV report are all worked out from that
table, never from the scorer. A run whose partition is there is not scored
again: a job that failed after the scoring goes on from the stored rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import scoring as R
from quarry.sources import files as FS

#: A stored prediction: what ``write_predictions`` keeps, and the question for the CSV report.
STORED_SCHEMA = ", ".join(["run_name string"] + [f"{c} {'double' if c.startswith('logit_') else 'string'}"
                                                 for c in FS.PREDICTION_COLUMNS] + ["question string"])


def stored_run(spark: SparkSession, predictions_dir: str, run_name: str) -> DataFrame:
    """The stored predictions of a run; no rows if it was never scored. Spark puts
    the folder of a run in place when its whole write is committed, so a run is
    there as a whole or not at all. Only that folder's files are read."""
    try:
        rows = spark.read.schema(STORED_SCHEMA).parquet(predictions_dir)
    except AnalysisException as e:  # the first run of a folder
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], STORED_SCHEMA)
    return rows.where(F.col("run_name") == run_name)


def evaluate_run(spark: SparkSession, run_name: str, score: Callable[[], DataFrame], output_dir: str, predictions_dir: str,
                 token_map: DataFrame | None = None, group: str = "specialty") -> DataFrame:
    """Score a run unless its predictions are stored, and write its sinks:
    ``<predictions_dir>/run_name=<run>`` (Parquet with logits),
    ``<output_dir>/results`` (JSON: accuracy, macro F1, total, scores per group,
    answer token ids) and ``<output_dir>/predictions`` (CSV, every cell quoted).
    ``score`` builds prediction rows with a ``question`` (``assemble_predictions``);
    it is called only when nothing is stored. Returns the stored predictions. A
    run without any row leaves no partition and is scored again."""
    if stored_run(spark, predictions_dir, run_name).isEmpty():
        FS.write_predictions(score().withColumn("run_name", F.lit(run_name)), predictions_dir, extra=("question",))
    preds = stored_run(spark, predictions_dir, run_name)
    FS.write_eval_results(R.eval_results(preds, group, ("run_name",), token_map), os.path.join(output_dir, "results"))
    FS.write_predictions_csv(preds, os.path.join(output_dir, "predictions"))
    return preds


def result_rows(results: DataFrame) -> DataFrame:
    """The nested summaries as flat rows, one per run and group; the token ids as
    a text such as ``A=5,B=7``."""
    tokens = F.array_join(F.transform(F.array_sort(F.map_entries("answer_token_ids")),
                                      lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    flat = results.select("run_name", "accuracy", "macro_f1", "total_samples", tokens.alias("answer_tokens"),
                          F.explode("per_specialty_scores").alias("specialty", "s"))
    return flat.select("run_name", "accuracy", "macro_f1", "total_samples", "answer_tokens", "specialty",
                       F.col("s.accuracy").alias("group_accuracy"), F.col("s.macro_f1").alias("group_macro_f1"),
                       F.col("s.count").alias("group_count"))
