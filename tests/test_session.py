"""Session settings: the cluster's own values stay, and nothing is written to a local folder there."""

import subprocess
import sys
from pathlib import Path

import pytest

from riskcard import session as S

REPO = str(Path(__file__).resolve().parents[1])

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false") \\
    .config("spark.sql.shuffle.partitions", "4000").config("spark.sql.adaptive.enabled", "false").getOrCreate()
from riskcard.session import get_session, release_scratch, scratch_path
s = get_session()
print("KEPT", s.conf.get("spark.sql.shuffle.partitions"), s.conf.get("spark.sql.adaptive.enabled"))
path = scratch_path(s, "x")
s.range(3).write.parquet(path)
release_scratch()
import os
print("GONE", not os.path.exists(path))
"""


def test_submitted_settings_stay():
    r = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, timeout=300)
    assert "KEPT 4000 false" in r.stdout and "GONE True" in r.stdout, r.stderr[-2000:]


class FakeConf:
    def get(self, key, default=None):
        return default


class FakeContext:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


class FakeSession:
    conf, sparkContext = FakeConf(), FakeContext()


def test_a_cluster_must_name_its_checkpoint_folder():
    with pytest.raises(RuntimeError):
        S.ensure_checkpoint_dir(FakeSession())
