"""Joins of rows with a table that has one row for each value of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def meet(rows: DataFrame, told: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with the other columns of told, which has one row for each value of the keys; null keys meet."""
    if not keys:
        return rows.join(F.broadcast(told))  # one row
    other = told.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return rows.join(other, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], how).drop(*[f"_r_{k}" for k in keys])
