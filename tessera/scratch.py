"""Lineage cuts in the shared scratch folder, and ordered prefix sums that rest on them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a new temporary folder where it is unset and Spark runs in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    """Removes this process's scratch tables when it ends; a cluster's own retention covers a driver that is killed."""
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended already
            return


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df as Parquet into the shared scratch folder and reads it back: later steps don't depend on how it was made."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote, once all that was made from them has been written; other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path and _delete(df.sparkSession, path):
            _written[:] = [(s, p) for s, p in _written if p != path]


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ordered_prefix(df: DataFrame, order: list[str], sums: list[str], name: str) -> DataFrame:
    """Rows of df with ``pos`` (0-based place in the order) and, for each column c of sums, ``c_before`` (sum of c over all earlier rows).

    Range partitions are written once; a window of one row per partition gives each its offset, so no task sees more
    than one range. The order must be total, or equal rows get their places in any order.
    """
    n = shuffle_parts(df.sparkSession)
    ranged = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), name)
    each = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    before = "ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"  # one row for each of the n partitions
    offsets = each.select("_part", F.expr(f"coalesce(sum(_n) OVER ({before}), 0L)").alias("_n0"), *[F.expr(f"coalesce(sum(_s_{c}) OVER ({before}), 0)").alias(f"_o_{c}") for c in sums])
    inside = f"PARTITION BY _part ORDER BY {', '.join(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    rows = ranged.select("*", F.expr(f"row_number() OVER (PARTITION BY _part ORDER BY {', '.join(order)}) - 1").cast("long").alias("_rn"), *[F.expr(f"coalesce(sum({c}) OVER ({inside}), 0)").alias(f"_b_{c}") for c in sums])
    joined = rows.join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, (F.col("_rn") + F.col("_n0")).alias("pos"), *[(F.col(f"_b_{c}") + F.col(f"_o_{c}")).alias(f"{c}_before") for c in sums])
