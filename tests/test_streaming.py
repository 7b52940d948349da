"""Streaming running metrics equal the batch metrics after each arrival."""

import os
import tempfile

from quarry.operators import metrics as M
from quarry.sources import files as FS
from quarry.sources import fixtures as X
from quarry.streaming.predictions import start_run_metrics
from tests.conftest import SF0001


def test_running_metrics_match_batch(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="quarry-stream-"), "predictions")
    preds = X.predictions(spark, SF0001)
    FS.write_predictions(preds.where("run_name like 'alpha%'"), d)
    q = start_run_metrics(spark, d, "running_metrics_test")
    try:
        q.processAllAvailable()
        first = spark.sql("select * from running_metrics_test").count()
        FS.write_predictions(preds.where("run_name like 'beta%'"), d)
        q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.sql("select * from running_metrics_test").collect())
    finally:
        q.stop()
    want = sorted(tuple(r) for r in M.run_metrics(preds).collect())
    assert first == 8
    assert got == want
