"""Saving without a configured shared folder."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import os
from pyspark.sql import SparkSession
from ripplespark.llm import tables
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
df = tables.saved(spark.range(5), "rows")
assert df.count() == 5 and tables.saved(df, "rows").count() == 5
folder = tables.shared_folder(spark.newSession())
assert folder == tables.shared_folder(spark) and len(os.listdir(folder)) == 2
print("folder", folder)
"""


def test_saved_in_a_session_without_checkpoint_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).parents[2])}
    said = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-2000:]
    assert not os.path.exists(said.stdout.split("folder ")[-1].strip())  # gone with its Python
