"""Bars, returns, calendars and levels of long panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import div, over, row_hash, so_far
from tessera.operators.asof import carry


def resample(ticks: DataFrame, unit: str, entity: str, time: str, value: str, qty: str) -> DataFrame:
    """Bars (entity, date, price, qty, high, low) per period of ticks with a value and a quantity: value-weighted price, summed quantity and the range of unit prices."""
    each = F.col(value) / F.col(qty)
    g = ticks.groupBy(entity, F.date_trunc(unit, time).cast("date").alias("date"))
    return g.agg((F.sum(value) / F.sum(qty)).alias("price"), F.sum(qty).alias("qty"), F.max(each).alias("high"), F.min(each).alias("low"))


def last_in_period(panel: DataFrame, unit: str, entity: str, time: str, price: str, qty: str) -> DataFrame:
    """A07 in its other form: the last price of the period by time, quantities summed."""
    g = panel.groupBy(entity, F.date_trunc(unit, time).cast("date").alias("period"))
    return g.agg(F.max_by(price, time).alias(price), F.sum(qty).alias(qty))


def with_returns(panel: DataFrame, entity: str, time: str, price: str) -> DataFrame:
    """Simple (r) and log (lr) returns; null where the price before is missing or not positive."""
    before = F.lag(price).over(over(entity, time))
    ratio = div(F.col(price), before)
    return panel.withColumn("r", ratio - 1).withColumn("lr", F.when(ratio > 0, F.log(ratio)))


def latest(panel: DataFrame, entity: str, time: str) -> DataFrame:
    """The last row of each entity; of rows at one time that of the largest hash, so reruns agree."""
    w = Window.partitionBy(entity).orderBy(F.col(time).desc(), row_hash(panel).desc())
    return panel.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_rows(panel: DataFrame, entity: str, time: str, n: int) -> DataFrame:
    """The last n rows of each entity; rows at one time in order of their hashes."""
    w = Window.partitionBy(entity).orderBy(F.col(time).desc(), row_hash(panel).desc())
    return panel.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def forward_fill(panel: DataFrame, entity: str, time: str, *columns: str) -> DataFrame:
    """Each null takes the entity's last value before it, by a scan over ranges of time."""
    return carry(panel, [entity], time, list(columns))


def date_pairs(dates: DataFrame, time: str) -> DataFrame:
    """Each distinct date with the one before it. The unpartitioned window holds one row per date."""
    w = Window.orderBy(time)
    return dates.select(time).distinct().select(F.col(time), F.lag(time).over(w).alias(f"{time}_0"))


def business_days(panel: DataFrame, entity: str, time: str) -> DataFrame:
    """W18, first step: every weekday between an entity's first and last date."""
    span = panel.groupBy(entity).agg(F.min(time).alias("_a"), F.max(time).alias("_z"))
    days = span.select(entity, F.explode(F.sequence("_a", "_z")).alias(time))
    return days.where(F.weekday(time) < 5)


def densify(panel: DataFrame, entity: str, time: str, price: str, qty: str) -> DataFrame:
    """Weekday grid, price filled forward, quantity 0 where nothing was traded; dates off the grid fall away."""
    grid = business_days(panel, entity, time).join(panel.select(entity, time, price, qty), [entity, time], "left")
    return forward_fill(grid, entity, time, price).withColumn(qty, F.coalesce(qty, F.lit(0.0)))


def levels(rets: DataFrame, group: str, time: str, r: str, base: float = 100.0) -> DataFrame:
    """Simple returns compounded to a level per group."""
    return rets.withColumn("level", base * F.exp(F.sum(F.log(F.greatest(1 + F.col(r), F.lit(1e-12)))).over(so_far(group, time))))


def group_returns(rets: DataFrame, groups: DataFrame, entity: str, group: str, time: str, r: str, least: int = 1) -> DataFrame:
    """Equal-weight return of each group and date with at least so many members."""
    g = rets.where(F.col(r).isNotNull()).join(groups.select(entity, group), entity).groupBy(group, time)
    return g.agg(F.avg(r).alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def horizon(panel: DataFrame, entity: str, time: str, price: str, rows: int, name: str) -> DataFrame:
    """Price over that of so many rows before, less 1."""
    return panel.withColumn(name, div(F.col(price), F.lag(price, rows).over(over(entity, time))) - 1)


def forward(panel: DataFrame, entity: str, time: str, price: str, rows: int, name: str = "fwd") -> DataFrame:
    """Return over the next rows."""
    return panel.withColumn(name, div(F.lead(price, rows).over(over(entity, time)), F.col(price)) - 1)


def month_ends(panel: DataFrame, time: str) -> DataFrame:
    """The last date of each calendar month that the panel has."""
    return panel.groupBy(F.date_trunc("month", time).cast("date").alias("month")).agg(F.max(time).alias("month_end"))


def rebase(index: DataFrame, universe: str, time: str, level: str, ref: str, base: float = 100.0) -> DataFrame:
    """Levels over that of the last date at or before ref, or else of the first after it."""
    at = F.lit(ref).cast("date")
    before = F.max_by(F.when(F.col(time) <= at, F.col(level)), F.when(F.col(time) <= at, F.col(time)))
    after = F.min_by(F.when(F.col(time) > at, F.col(level)), F.when(F.col(time) > at, F.col(time)))
    ref_levels = index.groupBy(universe).agg(F.coalesce(before, after).alias("_ref"))
    return index.join(ref_levels, universe).withColumn("rebased", base * div(F.col(level), F.col("_ref"))).drop("_ref")
