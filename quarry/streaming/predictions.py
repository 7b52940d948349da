"""Running per-run metrics over a prediction folder that keeps growing.

``readStream`` picks up new prediction files (one partition folder per run);
the confusion-count kernel is a streaming aggregation whose state is 27
counters per run, and the metrics are projections of that state. The query
checkpoints into the shared ``spark.checkpoint.dir``, so a restarted query
(or a lost executor) resumes from the last committed batch.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import metrics as M
from quarry.session import checkpoint_dir

PREDICTION_SCHEMA = ("run_name string, question_id long, gold_label string, pred_label string, "
                     "specialty string, umbrella_specialty string, level string")


def run_metrics_stream(spark: SparkSession, path: str, schema: str = PREDICTION_SCHEMA,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame: run_name, n, n_correct, accuracy, macro_f1 (both rules)."""
    reader = spark.readStream.schema(schema).option("basePath", path)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(path)
    wide = M.confusion_wide(stream, ["run_name"])
    return wide.select("run_name", "n", "n_correct", M.accuracy_col().alias("accuracy"),
                       M.macro_f1_fixed_col().alias("macro_f1"),
                       M.macro_f1_present_col().alias("macro_f1_present"))


def start_run_metrics(spark: SparkSession, path: str, query_name: str, sink: str = "memory") -> StreamingQuery:
    """Start the running-metrics query (``update`` mode: each batch emits the
    runs whose counts changed)."""
    ckpt = os.path.join(checkpoint_dir(spark), "streams", query_name)
    return (run_metrics_stream(spark, path).writeStream.outputMode("complete" if sink == "memory" else "update")
            .format(sink).queryName(query_name).option("checkpointLocation", ckpt).start())
