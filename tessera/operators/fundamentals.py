"""Trailing sums and revisions of statement lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import div, over


def trailing_year(df: DataFrame, entity: str, time: str, x: str) -> DataFrame:
    """Sum of four quarters and the stability |mean| / population deviation of the last eight; null until four and eight rows are there."""
    w = over(entity, time)
    four, eight = w.rowsBetween(-3, 0), w.rowsBetween(-7, 0)
    sd = F.stddev_pop(x).over(eight)
    return df.withColumns({"ttm": F.when(F.count(x).over(four) == 4, F.sum(x).over(four)), "stability": F.when((F.count(x).over(eight) == 8) & (sd > 0), F.abs(F.avg(x).over(eight)) / sd)})


def revisions(df: DataFrame, keys: list[str], time: str, x: str) -> DataFrame:
    """Percent change against the snapshot before, over its size."""
    before = F.lag(x).over(over(keys, time))
    return df.withColumn("revision", 100 * div(F.col(x) - before, F.abs(before)))
