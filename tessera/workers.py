"""Sets up Python workers: the library on their path, batches of bounded size."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Rows of one Arrow batch between Spark and a Python worker where the session leaves Spark's default: texts of some kB make batches of some MB.
BATCH_ROWS = 2000
#: Workers live through many jobs: large blocks go back to the system as soon as they are free.
MALLOC = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach(spark: SparkSession) -> SparkSession:
    """Adds the library's folder to the workers' PYTHONPATH and sets how they give memory back; where executors have no such folder (a cluster), ship the package with --py-files."""
    env = spark.sparkContext.environment
    for name, value in MALLOC.items():
        env.setdefault(name, value)
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [ROOT, *paths] if p)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark
