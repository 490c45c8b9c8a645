"""Python workers must import the package even when the driver's working
directory is elsewhere (on a cluster, executors only have shipped code)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as E
rows = E.queries()["bin_fit_desc"](spark, "/root/testdata/sf0.001").collect()
print("ROWS", len(rows))
"""


def test_udf_queries_run_from_another_directory():
    cwd = tempfile.mkdtemp(prefix="riskcard-cwd-", dir="/tmp")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                       timeout=600)
    assert "ROWS 5" in r.stdout, r.stderr[-3000:]
