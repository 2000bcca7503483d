"""Ranks and z-scores over whole tables, for tables of one row per entity or pair that are too long for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import div
from tessera.scratch import cut, ordered_prefix


def with_pct_ranks(df: DataFrame, ranks: dict[str, str]) -> DataFrame:
    """df with average-tie percentile ranks, new name to column; null stays null.

    Distinct values with their counts are range-partitioned and summed up in order, so no task sees the whole table.
    """
    for name, c in ranks.items():
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        placed = ordered_prefix(counts, ["_v"], ["_c"], "ranks")
        total = placed.agg(F.sum("_c").alias("_all"))
        told = placed.join(F.broadcast(total)).select("_v", div(F.col("_c_before") + (F.col("_c") + 1) / 2, F.col("_all")).alias(name))
        df = df.join(told, F.col(c) == F.col("_v"), "left").drop("_v")
    return df


def with_zscores(df: DataFrame, scores: dict[str, str]) -> DataFrame:
    """df with z-scores by the whole table's mean and sample deviation; 0 where that is 0 or missing or the value is null."""
    stats = df.agg(*[x for n, c in scores.items() for x in (F.avg(c).alias(f"_m_{n}"), F.stddev_samp(c).alias(f"_s_{n}"))])
    z = {n: F.when((F.col(f"_s_{n}") > 0) & F.col(c).isNotNull(), (F.col(c) - F.col(f"_m_{n}")) / F.col(f"_s_{n}")).otherwise(F.lit(0.0)) for n, c in scores.items()}
    return df.join(F.broadcast(stats)).withColumns(z).drop(*[f"_{k}_{n}" for k in "ms" for n in scores])


def with_rank(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """df with the rank of a column from its largest value on: 1 plus the number of rows with a larger one; nulls come last."""
    counts = df.groupBy(F.col(column).isNull().alias("_null"), (-F.col(column)).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    placed = cut(ordered_prefix(counts, ["_null", "_v"], ["_c"], "ranks").select("_v", (F.col("_c_before") + 1).cast("long").alias(name)), "ranks")
    return df.join(placed, (-F.col(column)).eqNullSafe(F.col("_v"))).drop("_v")
