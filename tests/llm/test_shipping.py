"""Operators on DataFrames of a session that knows nothing of the package: another folder, no path, no settings."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

BARE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from lodestone.llm import embeddings, langid, lines, neardup, packing, templates, toxicity
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(i, "some words that stand here and there " * 3, "en") for i in range(6)], "doc_id long, text string, lang string")
first = sys.argv[2]
if first == "lines":
    assert lines.dedup_lines(docs).count() == 6
elif first == "near":
    assert neardup.first_of_each(docs).count() == 1
elif first == "embeddings":
    assert embeddings.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)], "vec_id long, embedding array<float>, label int")).where("n_links = 1").count() == 2
else:
    assert packing.pack_documents(docs).count() > 0
    assert langid.identify(docs, langid.build({"en": "some words"})).count() == 6
    assert toxicity.score(docs, toxicity.constant(0.5)).count() == 6
    turns = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert templates.digest_conversations(templates.format_conversations(turns)).count() == 1
print("FINE")
"""


def test_bare_sessions(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_CONF_DIR": str(tmp_path)}
    for first in ("lines", "near", "embeddings", "others"):
        run = subprocess.run([sys.executable, "-c", BARE, str(ROOT), first], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=200, check=False)
        assert "FINE" in run.stdout, (first, run.stderr[-2000:])
