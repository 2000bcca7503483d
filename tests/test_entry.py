"""The entry module without the training-data part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
names = e.queries()
assert len(names) > 200 and not [n for n in names if n.startswith("op") or n == "pipeline"], sorted(names)[:5]
assert set(e.oracle_sql()) <= set(names)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() > 0
"""


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_queries_load_without_the_training_data_part(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path / "r", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr[-3000:]
