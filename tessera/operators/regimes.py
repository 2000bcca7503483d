"""State series: entropy, spells, transitions, crisis masks, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Least posterior of a label, floor of a probability, and the upper ends of the entropy bins.
SOFT, FLOOR = 0.7, 1e-12
ENTROPY_BINS = {"low": 0.3, "mid": 0.6, "high": 1.0}


def entropy(p: Column) -> Column:
    """Shannon entropy of an array of probabilities over that of equal ones, so from 0 to 1; probabilities are held above a floor and made to sum to 1."""
    held = F.transform(p, lambda x: F.least(F.greatest(x, F.lit(FLOOR)), F.lit(1.0)))
    total = F.aggregate(held, F.lit(0.0), lambda a, x: a + x)
    return -F.aggregate(held, F.lit(0.0), lambda a, x: a + x / total * F.log(x / total)) / F.log(F.size(p))


def soft_label(p: Column, labels: list[str], soft: float = SOFT) -> Column:
    """The label of the largest posterior, the first of equal ones; "uncertain" where that is below soft."""
    best = F.array_position(p, F.array_max(p)).cast("int")
    return F.when(F.array_max(p) < soft, "uncertain").otherwise(F.element_at(F.array(*map(F.lit, labels)), best))


def entropy_bin(h: Column) -> Column:
    """Low, mid or high, each up to its end; null for an entropy of 0 or less."""
    out = F.when(h <= 0, F.lit(None).cast("string"))
    for name, end in ENTROPY_BINS.items():
        out = out.when(h <= end, name)
    return out


def transitions(states: DataFrame, time: str, state: str) -> DataFrame:
    """Share of each next state. One row per date, so the window is small."""
    nxt = states.select(F.col(state).alias("from"), F.lead(state).over(Window.orderBy(time)).alias("to")).where("to IS NOT NULL")
    g = nxt.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from")))


def triggers(states: DataFrame, time: str, state: str, x: str) -> DataFrame:
    """Switches, with the mean change of x over 1 and 5 rows for each pair of states."""
    w = Window.orderBy(time)
    s = states.select(F.lag(state).over(w).alias("from"), F.col(state).alias("to"), (F.col(x) - F.lag(x).over(w)).alias("d1"), (F.col(x) - F.lag(x, 5).over(w)).alias("d5")).where(F.col("from") != F.col("to"))
    return s.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"), F.avg("d1").alias("d1"), F.avg("d5").alias("d5"))


def crisis_masks(market: DataFrame, time: str, r: str, rows: int = 6) -> DataFrame:
    """Flags for the top fifth of volatility, the worst 5 % of returns and the deepest tenth of drawdowns."""
    w = Window.orderBy(time)
    m = market.withColumn("vol", F.when(F.count(r).over(w.rowsBetween(-(rows - 1), 0)) >= rows, F.stddev_samp(r).over(w.rowsBetween(-(rows - 1), 0))))
    m = m.withColumn("_l", F.exp(F.sum(F.log1p(r)).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    m = m.withColumn("dd", F.col("_l") / F.max("_l").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_l")
    q = m.agg(F.percentile("vol", F.lit(0.8)).alias("_v"), F.percentile(r, F.lit(0.05)).alias("_r"), F.percentile("dd", F.lit(0.1)).alias("_d"))
    return m.join(F.broadcast(q)).withColumns({"high_vol": F.coalesce(F.col("vol") >= F.col("_v"), F.lit(False)), "worst": F.col(r) <= F.col("_r"), "deep": F.col("dd") <= F.col("_d")}).drop("_v", "_r", "_d")


def mixture_labels(features: DataFrame, columns: list[str], order_by: str, states: int = 3, seed: int = 5) -> DataFrame:
    """States of a Gaussian mixture over standardised features, numbered by their mean of ``order_by``; posteriors as an array."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    full = features.dropna(subset=columns)
    x = VectorAssembler(inputCols=columns, outputCol="_raw").transform(full)
    x = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(x).transform(x)
    model = GaussianMixture(k=states, featuresCol="_x", predictionCol="_state", probabilityCol="_p", seed=seed, maxIter=50).fit(x)
    out = model.transform(x).withColumn("posterior", vector_to_array("_p"))
    means = out.groupBy("_state").agg(F.avg(order_by).alias("_m")).withColumn("state", F.row_number().over(Window.orderBy("_m")) - 1)  # one row per state
    return out.join(F.broadcast(means.select("_state", "state")), "_state").drop("_raw", "_x", "_p", "_state")


def majority(states: DataFrame, entity: str | None, time: str, state: str, rows: int = 20) -> DataFrame:
    """The most frequent state of the last rows, the smallest name on ties."""
    part = Window.partitionBy(*([entity] if entity else [])).orderBy(time).rowsBetween(-(rows - 1), 0)
    held = F.collect_list(state).over(part)  # at most ``rows`` values
    count = F.transform(F.array_sort(F.array_distinct(held)), lambda s: F.struct(F.size(F.filter(held, lambda x: x == s)).alias("n"), s.alias("s")))
    best = F.aggregate(count, F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("s")), lambda a, c: F.when(c["n"] > a["n"], c).otherwise(a))
    return states.withColumn("majority", best["s"])


#: What a rebalancing date does and how far it may go, under stress and otherwise.
PLANS = {True: ("reduced_rebalance", 0.5), False: ("full_rebalance", 1.0)}


def rebalance_plan(dates: DataFrame, regime: str = "regime") -> DataFrame:
    """Dates with their regime (unknown: normal), action and turnover band; every regime whose name speaks of stress halves the band."""
    stress = F.lower(F.col(regime)).contains("stress")
    known = dates.withColumn(regime, F.coalesce(regime, F.lit("normal")))
    return known.withColumns({"action": F.when(stress, PLANS[True][0]).otherwise(PLANS[False][0]), "turnover_band": F.when(stress, PLANS[True][1]).otherwise(PLANS[False][1])})
