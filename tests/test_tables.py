"""The scratch folder: in a session without spark.checkpoint.dir, and its deletion."""

import os
import subprocess
import sys
from pathlib import Path

from lodestone.sources import tables

ROOT = Path(__file__).resolve().parents[1]

BARE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from lodestone.sources import tables
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
df = tables.materialize(spark.range(3), "x")
assert df.count() == 3 and tables.materialize(df, "x").count() == 3
print("FOLDER", tables.scratch_dir(spark).removeprefix("file://"))
"""


def test_bare_session(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", BARE, str(ROOT)], env=env, capture_output=True, text=True, timeout=120, check=True)
    folder = run.stdout.split("FOLDER ")[1].strip()
    assert "lodestone" in folder and not Path(folder).exists()


def test_clean(spark):
    df = tables.materialize(spark.range(3), "x")
    assert df.count() == 3
    fs, p = tables.file_system(spark, tables.scratch_dir(spark))
    assert fs.exists(p)
    tables.clean(spark)
    assert not fs.exists(p) and tables.materialize(spark.range(2), "y").count() == 2
