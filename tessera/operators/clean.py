"""Panel audits and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import div, over, so_far
from tessera.operators.windows import spells


def price_jumps(panel: DataFrame, entity: str, time: str, price: str, limit: float = 0.35) -> DataFrame:
    """Rows whose one-step return exceeds the limit in size."""
    out = panel.withColumn("ret", div(F.col(price), F.lag(price).over(over(entity, time))) - 1)
    return out.where(F.abs("ret") > limit)


def clean_prices(panel: DataFrame, entity: str, time: str, price: str, qty: str, clip_ret: float = 0.35, min_price: float = 0.01) -> DataFrame:
    """Prices under the floor and quantities at or under 0 become null and are filled forward; a step whose return on the filled price exceeds the clip is nulled and filled again."""
    w, fill = over(entity, time), so_far(entity, time)
    out = panel.withColumn("_p", F.last(F.when(F.col(price) >= min_price, F.col(price)), ignorenulls=True).over(fill))
    step = div(F.col("_p"), F.lag("_p").over(w)) - 1
    out = out.withColumn("_p", F.when(F.coalesce(F.abs(step) <= clip_ret, F.lit(True)), F.col("_p")))
    return out.withColumns({price: F.last("_p", ignorenulls=True).over(fill), qty: F.last(F.when(F.col(qty) > 0, F.col(qty)), ignorenulls=True).over(fill)}).drop("_p")


#: Price ratios of common splits and how near a move must come.
SPLITS = (1 / 2, 2.0, 1 / 3, 3.0, 1 / 4, 4.0, 1 / 5, 5.0)


def suspected_splits(panel: DataFrame, entity: str, time: str, price: str, tolerance: float = 0.03) -> DataFrame:
    """Steps whose price ratio lies within the tolerance of a split's."""
    out = panel.withColumn("ratio", div(F.col(price), F.lag(price).over(over(entity, time))))
    near = F.coalesce(*[F.when(F.abs(F.col("ratio") / s - 1) <= tolerance, F.lit(s)) for s in SPLITS])
    return out.withColumn("split", near).where("split IS NOT NULL")


def flat_runs(panel: DataFrame, entity: str, time: str, price: str, least: int) -> DataFrame:
    """The longest run of unchanged prices of each entity, if it has at least so many rows."""
    flag = panel.withColumn("_same", F.coalesce(F.col(price) == F.lag(price).over(over(entity, time)), F.lit(False)))
    runs = spells(flag, entity, time, "_same")
    return runs.groupBy(entity).agg((F.max("n") + 1).alias("longest"), F.max_by("start", "n").alias("start")).where(F.col("longest") >= least)


def missingness(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows, missing, share and non-positive count of each field, in one pass."""
    one = df.agg(*[x for f in fields for x in (F.count(F.lit(1)).alias(f"n_{f}"), F.count_if(F.col(f).isNull()).alias(f"missing_{f}"), F.count_if(F.col(f) <= 0).alias(f"bad_{f}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("n"), F.col(f"missing_{f}").alias("missing"), F.col(f"bad_{f}").alias("non_positive")) for f in fields]))
    return one.select(rows.alias("x")).select("x.*").withColumn("share", div(F.col("missing").cast("double"), F.col("n")))


def two_sided_drop(panel: DataFrame, entity: str, time: str, price: str, limit: float) -> DataFrame:
    """Rows out whose log move in or log move out exceeds the limit; then the mean per entity and date."""
    w = over(entity, time)
    ok = F.coalesce(F.abs(F.log(div(F.col(price), F.lag(price).over(w)))) <= limit, F.lit(True)) & F.coalesce(F.abs(F.log(div(F.lead(price).over(w), F.col(price)))) <= limit, F.lit(True))
    return panel.withColumn("_ok", ok).where("_ok").groupBy(entity, time).agg(F.avg(price).alias(price))


def unadjusted(panel: DataFrame, entity: str, close: str, adjusted: str, tolerance: float = 1e-4) -> DataFrame:
    """Entities whose adjusted series equals the raw one, or that have no valid adjusted rows."""
    gap = F.avg(F.abs(div(F.col(adjusted), F.col(close)) - 1))
    return panel.groupBy(entity).agg(gap.alias("gap")).where(F.col("gap").isNull() | (F.col("gap") < tolerance))


def pit_dedupe(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key, that of the highest sequence number."""
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def jump_summary(panel: DataFrame, entity: str, time: str, price: str) -> DataFrame:
    """How many moves there are, the shares of those over 10, 25 and 35 % either way, and how many look like splits: within 3 % of halving, doubling and so on up to five."""
    ratio = div(F.col(price), F.lag(price).over(over(entity, time)))
    x = panel.select(ratio.alias("_q")).where("_q IS NOT NULL")
    near = F.exists(F.array(*[F.lit(t) for k in (2.0, 3.0, 4.0, 5.0) for t in (k, 1 / k)]), lambda t: F.abs(F.col("_q") - t) / t < 0.03)
    share = lambda k: F.avg((F.abs(F.col("_q") - 1) > k).cast("double"))
    return x.agg(F.count(F.lit(1)).alias("n"), share(0.10).alias("over_10"), share(0.25).alias("over_25"), share(0.35).alias("over_35"), F.count_if(near).alias("splits"))
