"""The driver may load __spark_entry__.py from any working directory: the
Python workers must still import the package (shipped with addPyFile)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {os.path.join(ROOT, "__spark_entry__.py")!r})
m = importlib.util.module_from_spec(spec)
spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
print("ROWS", m.queries()["bootstrap_ci"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_python_workers_import_package_from_any_cwd():
    cwd = tempfile.mkdtemp(prefix="quarry-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "ROWS 12" in out.stdout, out.stderr[-2000:]
