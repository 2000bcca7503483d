"""Chained price and quantity indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import div, over, so_far
from tessera.operators.returns import date_pairs

KINDS = ["laspeyres_p", "paasche_p", "fisher_p", "laspeyres_q", "paasche_q", "fisher_q"]


def links(panel: DataFrame, entity: str, time: str, price: str, qty: str, by: list[str]) -> DataFrame:
    """J01 and the links of W03: four sums over the entities that trade on consecutive dates, one row per date and universe.

    An entity's row before carries its price and quantity along by ``lag``; it counts where it lies on the date before,
    so the panel isn't joined to itself. One row per entity and date. The dates are one row each.
    """
    pq = panel.where(F.col(price) > 0).withColumn(qty, F.coalesce(F.last(qty, ignorenulls=True).over(so_far([*by, entity], time)), F.lit(1.0)))
    days = date_pairs(pq, time).where(F.col(f"{time}_0").isNotNull())
    w = over([*by, entity], time)
    now = pq.select(*by, time, F.col(price).alias("p1"), F.col(qty).alias("q1"), F.lag(price).over(w).alias("p0"), F.lag(qty).over(w).alias("q0"), F.lag(time).over(w).alias("_was"))
    pair = now.join(days, time).where((F.col("_was") == F.col(f"{time}_0")) & (F.col("q0") > 0) & (F.col("q1") > 0))
    s = pair.groupBy(*by, time, f"{time}_0").agg(*[F.sum(F.col(a) * F.col(b)).alias(a + b) for a in ("p0", "p1") for b in ("q0", "q1")], F.count(F.lit(1)).alias("n_items"))
    one = F.lit(1.0)
    s = s.select(*by, time, f"{time}_0", "n_items", F.coalesce(div(F.col("p1q0"), F.col("p0q0")), one).alias("laspeyres_p"), F.coalesce(div(F.col("p1q1"), F.col("p0q1")), one).alias("paasche_p"), F.coalesce(div(F.col("p0q1"), F.col("p0q0")), one).alias("laspeyres_q"), F.coalesce(div(F.col("p1q1"), F.col("p1q0")), one).alias("paasche_q"))
    return s.withColumns({f"fisher_{k}": F.sqrt(F.col(f"laspeyres_{k}") * F.col(f"paasche_{k}")) for k in ("p", "q")})


def fisher_chain(panel: DataFrame, entity: str, time: str, price: str, qty: str, by: list[str]) -> DataFrame:
    """Levels from 100 at the first linked date; the windows are partitioned by universe, one row per date each."""
    found = links(panel, entity, time, price, qty, by)
    seed = found.groupBy(*by).agg(F.min(f"{time}_0").alias(time)).select(*by, time, F.lit(None).cast("long").alias("n_items"), *[F.lit(1.0).alias(k) for k in KINDS])
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    all_links = seed.unionByName(found.drop(f"{time}_0"))
    return all_links.select(*by, time, "n_items", *[(100 * F.exp(F.sum(F.log(F.greatest(F.col(k), F.lit(1e-12)))).over(w))).alias(k) for k in KINDS])


def rates(index: DataFrame, by: list[str], time: str, periods: int = 252, most: int = 21, least: int = 5) -> DataFrame:
    """Price and quantity rates, the gap of their product to the nominal rate, cumulative factors, and percent rates a year (ann_p, ann_q, ann_n) over a tenth of the group's rows, ``least`` to ``most`` of them."""
    w = over(by, time)
    out = index.withColumns({f"rate_{k}": div(F.col(f"fisher_{k}"), F.lag(f"fisher_{k}").over(w)) - 1 for k in ("p", "q")})
    nominal = F.col("fisher_p") * F.col("fisher_q")
    out = out.withColumn("rate_n", div(nominal, F.lag(nominal).over(w)) - 1)
    gap = F.col("rate_n") - ((1 + F.col("rate_p")) * (1 + F.col("rate_q")) - 1)
    rows = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.count(F.lit(1)).over(Window.partitionBy(*by)) / 10))).cast("int")
    held = lambda level: F.collect_list(level).over(w.rowsBetween(-most, 0))  # noqa: E731 - the levels of the last rows, the present one last
    back = lambda level: F.get(held(level), F.size(held(level)) - 1 - rows)
    ann = lambda level: 100 * (F.pow(div(level, back(level)), periods / rows) - 1)
    out = out.withColumns({"ann_p": ann(F.col("fisher_p")), "ann_q": ann(F.col("fisher_q")), "ann_n": ann(nominal)})
    return out.withColumn("gap", gap).withColumns({f"cum_{k}": F.col(f"fisher_{k}") / 100 for k in ("p", "q")})
