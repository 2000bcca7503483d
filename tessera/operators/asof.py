"""Joins by time: as-of, interval membership and nearest event. Spark has no as-of join; a scan by ranges of time does it in linear work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.keys import meet


def carry(df: DataFrame, keys: list[str], time: str, columns: list[str], then: list[str] | None = None, forward: bool = False, unit: str = "month") -> DataFrame:
    """df with each column's last value that isn't null up to the row, in order of time (and of ``then`` inside one), per key; forward: the first from the row on.

    A scan by ranges of time: the last values of each key and range are aggregated before any shuffle, a window over these
    few rows tells what every range begins with, and the rows are filled inside their range. So a key that holds all rows
    spreads over as many tasks as it has ranges; a task sees one range of one key (``unit`` of a date, or 1,000 steps of a
    number). Rows without time come first, as a range of their own.
    """
    kind = df.schema[time].dataType.typeName()
    span = F.date_trunc(unit, F.col(time)) if kind in ("date", "timestamp", "timestamp_ntz") else F.floor(F.col(time) / 1000)
    then = then or []
    place = F.struct(F.col(time).isNotNull(), F.col(time), *then)
    pick = F.min_by if forward else F.max_by
    rows = df.withColumn("_span", span)
    ends = rows.groupBy(*keys, "_span").agg(*[pick(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])
    turn = F.desc if forward else F.asc
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy(turn("_span")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    begins = ends.select(*keys, "_span", *[F.last(c, ignorenulls=True).over(before).alias(c) for c in columns], F.lit(0).alias("_real"))
    both = rows.withColumn("_real", F.lit(1)).unionByName(begins, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_span").orderBy("_real", turn(time), *[turn(c) for c in then]).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns}).where("_real = 1").select(*df.columns)


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, columns: list[str], by: list[str], forward: bool = False, unit: str = "month") -> DataFrame:
    """Each left row with the named columns of the last right row at or before its time (forward: the first at or after it).

    Without a matching row the columns are null; of right rows at one time the greatest in order of the columns counts;
    null keys meet. The right rows are carried (see ``carry``) to the distinct keys and times of the left side, which its
    rows then look up, so neither a hot key nor an empty ``by`` puts a side into one task.
    """
    fields = F.struct(*[F.col(c) for c in columns])
    key = [f"_k{i}" for i in range(len(by))]
    asked = left.select(*[F.col(c).alias(k) for c, k in zip(by, key, strict=True)], F.col(left_time).alias("_t")).where("_t IS NOT NULL").distinct()
    known = right.where(F.col(right_time).isNotNull()).groupBy(*[F.col(c).alias(k) for c, k in zip(by, key, strict=True)], F.col(right_time).alias("_t")).agg(F.max(fields).alias("_r"))
    # A right row comes before a left one at the same time, whichever way the scan runs.
    both = asked.withColumn("_side", F.lit(-1 if forward else 1)).unionByName(known.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    told = carry(both, key, "_t", ["_r"], ["_side"], forward, unit).where("_side <> 0").drop("_side")
    rows = left.withColumn("_l", F.struct(*[F.col(f"`{c}`") for c in left.columns])).select("_l", *[F.col(c).alias(k) for c, k in zip(by, key, strict=True)], F.col(left_time).alias("_t"))
    return meet(rows, told, [*key, "_t"], "left").select("_l.*", *[F.col("_r").getField(c).alias(c) for c in columns])


def members_at(dates: DataFrame, time: str, adds: DataFrame, removes: DataFrame, entity: str, event_time: str, floor: str = "1900-01-01") -> DataFrame:
    """(date, entity) where the first add is at or before the date and the first removal, if any, after it; unknown adds count from the floor.

    The distinct dates, which are few, travel as one array; each entity's interval is exploded to the dates inside it, so
    no pair of entity and date is compared in a join.
    """
    first = adds.groupBy(entity).agg(F.min(event_time).alias("_add"))
    gone = removes.groupBy(entity).agg(F.min(event_time).alias("_rem"))
    spans = first.join(gone, entity, "full_outer").withColumn("_add", F.coalesce("_add", F.lit(floor).cast("date")))
    days = dates.select(time).distinct().agg(F.collect_list(time).alias("_days"))
    inside = F.filter("_days", lambda x: (F.col("_add") <= x) & (F.col("_rem").isNull() | (F.col("_rem") > x)))
    return spans.join(F.broadcast(days)).select(F.explode(inside).alias(time), entity)


def _spread(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """df dealt by the keys over so many tasks; as Spark has it without a number."""
    return df.repartition(tasks, *keys) if tasks else df


def around(df: DataFrame, keys: list[str], time: str, column: str, then: str, unit: str = "month", tasks: int | None = None) -> DataFrame:
    """df with ``_back`` and ``_next``: the column's last value that isn't null up to the row and the first one from it on, per key; of rows of one time those with lower ``then`` come first both ways.

    One scan by ranges of time as in ``carry``: what a range begins and ends with is told by a row for each range, and both
    directions are filled where the range lies. Times aren't null.
    """
    rows = df.withColumn("_span", F.date_trunc(unit, F.col(time)))
    place = F.when(F.col(column).isNotNull(), F.col(time))
    ends = _spread(rows, tasks, *keys, "_span").groupBy(*keys, "_span").agg(F.max_by(column, place).alias("_last"), F.min_by(column, place).alias("_first"))
    beside = lambda turn: Window.partitionBy(*keys).orderBy(turn("_span")).rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731 - a row for each range
    begins = _spread(ends, tasks, *keys).select(*keys, "_span", F.last("_last", ignorenulls=True).over(beside(F.asc)).alias("_back"), F.last("_first", ignorenulls=True).over(beside(F.desc)).alias("_next"), F.lit(0).alias("_real"))
    both = rows.withColumns({"_back": F.col(column), "_next": F.col(column), "_real": F.lit(1)}).unionByName(begins, allowMissingColumns=True)
    inside = lambda turn: Window.partitionBy(*keys, "_span").orderBy("_real", turn(time), then).rowsBetween(Window.unboundedPreceding, 0)
    filled = _spread(both, tasks, *keys, "_span").withColumns({c: F.last(c, ignorenulls=True).over(inside(turn)) for c, turn in (("_back", F.asc), ("_next", F.desc))})
    return filled.where("_real = 1").drop("_span", "_real")


def nearest(events: DataFrame, panel: DataFrame, entity: str, event_time: str, time: str, price: str, offsets: list[int], tasks: int | None = None) -> DataFrame:
    """Each event's nearest observation (the earlier on ties) and the returns so many rows later; null without one, and events without entity or time meet none.

    The distinct entities and times of the events find theirs in one scan (``around``) and are looked up by the events.
    tasks: over how many tasks the events are dealt, where they are more than Spark's own number of tasks can hold.
    """
    w = Window.partitionBy(entity).orderBy(time)
    names = [f"ret_{h}" for h in offsets]
    later = [(F.try_divide(F.lead(price, h).over(w), F.col(price)) - 1).alias(n) for n, h in zip(names, offsets, strict=True)]
    given = panel.where(F.col(entity).isNotNull() & F.col(time).isNotNull()).select(entity, time, price)
    known = _spread(given, tasks, entity).select(F.col(entity).alias("_k"), F.col(time).alias("_t"), *later).groupBy("_k", "_t").agg(F.max(F.struct("_t", *names)).alias("_r"))
    asked = _spread(events.select(F.col(entity).alias("_k"), F.col(event_time).alias("_t")).where("_k IS NOT NULL AND _t IS NOT NULL"), tasks, "_k", "_t").distinct()
    both = asked.withColumn("_side", F.lit(1)).unionByName(known.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    gap = lambda s: F.abs(F.datediff(F.col(f"{s}._t"), F.col("_t")))
    use_back = F.col("_back").isNotNull() & (F.col("_next").isNull() | (gap("_back") <= gap("_next")))
    told = around(both, ["_k"], "_t", "_r", "_side", tasks=tasks).where("_side = 1").select("_k", "_t", F.when(use_back, F.col("_back")).otherwise(F.col("_next")).alias("_n"))
    told = _spread(told.select("_k", "_t", F.col("_n._t").alias("_seen"), *[F.col(f"_n.{n}").alias(f"_{n}") for n in names]), tasks, "_k", "_t")
    found = _spread(events, tasks, entity, event_time).join(told, [F.col(entity) == F.col("_k"), F.col(event_time) == F.col("_t")], "left")
    return found.select(*[F.col(f"`{c}`") for c in events.columns], F.col("_seen").alias("observed"), *[F.col(f"_{n}").alias(n) for n in names])
