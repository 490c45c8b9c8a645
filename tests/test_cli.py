"""The command line: a table and a dictionary in, a report folder out."""

import csv
import os
import subprocess
import sys

from conftest import SMALL
from pyspark.sql import functions as F

from riskcard.session import scratch_path
from riskcard.sources import fixture as FX

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_cli_writes_report(spark, tmp_path):
    apps = scratch_path(spark, "apps") + ".parquet"
    FX.applications(spark, SMALL).write.parquet(apps)
    dict_path = tmp_path / "dictionary.csv"
    with open(dict_path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["Variable Name (ReNamed)", "Type", "Sign"])
        for r in FX.DICTIONARY_ROWS:
            w.writerow(["" if v is None else v for v in r])
    out = tmp_path / "reports"
    env = dict(os.environ, PYTHONPATH=REPO)
    r = subprocess.run([sys.executable, "-m", "riskcard", "--input", apps, "--target", "pi", "--id", "app_id",
                        "--dictionary", str(dict_path), "--new-asc", "avg_disc", "--project", "demo",
                        "--out", str(out), "--master", "local[2]"],
                       cwd=str(tmp_path), env=env, capture_output=True, text=True, timeout=900)
    assert r.returncode == 0, r.stderr[-3000:]
    root = r.stdout.strip().splitlines()[-1]
    tables = set(os.listdir(root))
    assert {"scorecard", "ppt", "missing_rate", "iv", "feature_status", "grid", "bins", "optimal_cutoff", "ks_point",
            "histogram", "ks_curve", "correlations", "coefficients", "model_metrics", "scored"} <= tables
    bins = spark.read.parquet(f"{root}/bins")
    for f in {r["feature"] for r in bins.select("feature").distinct().collect()}:
        labels = {r["label"] for r in bins.where(F.col("feature") == f).collect()}
        assert {"Special", "Missing", "Totals"} <= labels
    scored = spark.read.parquet(f"{root}/scored")
    assert {"score", "raw_score", "odds", "probs"} <= set(scored.columns) and scored.count() == 1500
    assert spark.read.parquet(f"{root}/coefficients").where("label like '% = %'").count() > 0
    assert spark.read.parquet(f"{root}/grid").count() == 36
