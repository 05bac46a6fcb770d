"""The shared folder where the session names none."""

import os
import subprocess
import sys
from pathlib import Path

JOB = """
from pyspark.sql import SparkSession
from omicsgraph.sources.shared import materialize, shared_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert materialize(spark.range(5), "five").count() == 5
assert shared_dir(spark) == shared_dir(spark)
print("same folder")
"""


def test_session_without_the_setting(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", JOB], env=env, cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("same folder"), done.stderr[-2000:]
