"""Portfolio overlays and the rotation between factor sleeves, over one row of sleeve returns per date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import cut, ordered_prefix

#: Strategies as combinations of sleeves (base, low, etf, dual, quality) and the market's return.
STRATEGIES = {
    "defensive_ew": "base",
    "cash_10": "0.9D * base",
    "cash_20": "0.8D * base",
    "low_vol_tilt": "0.7D * base + 0.3D * low",
    "dividend_etf_30": "0.7D * base + 0.3D * etf",
    "put_proxy": "base - 0.4D * IF(mkt < -0.015D, mkt, 0D)",
    "dual_quality": "0.5D * dual + 0.5D * quality",
    "tail_combo": "0.2D * low + 0.2D * etf + 0.5D * base",
}
#: What is recommended in each regime, and the mix in all others.
RECOMMENDED = {"high_vol_stress": "tail_combo", "low_vol": "defensive_ew", "uncertain": "cash_10"}
OTHERWISE = "0.85D * defensive_ew + 0.15D * low_vol_tilt"
CRISIS = 0.8

#: Weights of the six sleeves in each state of the rotation.
SLEEVES = ("quality", "value", "low_vol", "dividend", "dual", "defensive")
WEIGHTS = {
    "start": (0.20, 0.20, 0.20, 0.20, 0.10, 0.10),
    "risk_off": (0.10, 0.10, 0.30, 0.30, 0.05, 0.15),
    "risk_on": (0.25, 0.15, 0.15, 0.10, 0.20, 0.15),
    "value_cheap": (0.15, 0.30, 0.15, 0.15, 0.15, 0.10),
    "neutral": (0.20, 0.20, 0.20, 0.15, 0.10, 0.15),
}
CALM_QUANTILE, STRESS_QUANTILE = 0.5, 0.8


def calmest(rets: DataFrame, entity: str, time: str, r: str, rows: int, least: int, share: int) -> DataFrame:
    """The entities of the lowest deviation over their last rows: one in ``share``, but ``least`` at least."""
    newest = Window.partitionBy(entity).orderBy(F.desc(time))
    v = rets.where(F.col(r).isNotNull()).withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= rows).groupBy(entity).agg(F.stddev_samp(r).alias("_v")).where("_v IS NOT NULL")
    placed = ordered_prefix(v, ["_v", entity], [], "calm")
    n = placed.agg(F.greatest(F.lit(least), F.floor(F.count(F.lit(1)) / share)).alias("_n"))
    return placed.join(F.broadcast(n)).where(F.col("pos") < F.col("_n")).select(entity)  # n is one row


def strategies(sleeves: DataFrame, time: str, regime: Column) -> DataFrame:
    """(time, strategy, r, mkt) for every strategy and the one recommended in the regime."""
    x = sleeves.withColumns({n: F.expr(e) for n, e in STRATEGIES.items()})
    pick = F.expr(OTHERWISE)
    for name, strategy in RECOMMENDED.items():
        pick = F.when(regime == name, F.col(strategy)).otherwise(pick)
    each = [F.struct(F.lit(n).alias("strategy"), c.alias("r")) for n, c in {**{n: F.col(n) for n in STRATEGIES}, "regime_recommended": pick}.items()]
    return x.select(time, "mkt", F.explode(F.array(*each)).alias("_x")).select(time, "mkt", "_x.*")


def crisis_dates(sleeves: DataFrame, time: str, rows: int) -> DataFrame:
    """(time, crisis): whether the market's volatility over its last rows is in its top fifth. One row per date."""
    w = Window.orderBy(time).rowsBetween(-(rows - 1), 0)
    v = sleeves.select(time, F.when(F.count("mkt").over(w) >= rows, F.stddev_samp("mkt").over(w)).alias("_v"))
    limit = v.agg(F.percentile("_v", F.lit(CRISIS)).alias("_q"))
    return v.join(F.broadcast(limit)).select(time, F.coalesce(F.col("_v") >= F.col("_q"), F.lit(False)).alias("crisis"))


def log_return_stats(series: DataFrame, by: list[str], time: str, r: str, year: int, least: int = 10) -> DataFrame:
    """Yearly return and volatility, their ratio, the deepest drawdown of the compounded log returns, the 5 % quantile and the mean at or below it; groups of fewer than ``least`` rows are left out. A series holds one row per date."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    x = series.withColumn("_l", F.exp(F.sum(r).over(w)))
    x = x.withColumn("_dd", F.col("_l") / F.max("_l").over(w) - 1).withColumn("_var", F.percentile(r, F.lit(0.05)).over(Window.partitionBy(*by)))
    g = x.groupBy(*by).agg(F.count(r).alias("_n"), (F.avg(r) * year).alias("ret"), (F.stddev_samp(r) * year**0.5).alias("vol"), F.min("_dd").alias("max_dd"), F.max("_var").alias("var"), F.avg(F.when(F.col(r) <= F.col("_var"), F.col(r))).alias("shortfall"))
    return g.where(F.col("_n") >= least).withColumn("sharpe", F.when(F.col("vol") > 0, F.col("ret") / F.col("vol"))).drop("_n")


def rotation(sleeves: DataFrame, time: str, regime: str, vol_rows: int, span: int, least: int, spread_rows: int) -> DataFrame:
    """(time, state, regime, a weight w_<sleeve> for each sleeve, ret): what each date holds by what was known the date before.

    The market's volatility over ``vol_rows`` is held against its median and 80 % quantile over the last ``span`` values:
    at or over the quantile, or in stress, risk is off; in a calm regime it is on; an uncertain regime is neither. Value
    is cheap where its sleeve returned less than quality over ``spread_rows``. Before ``least`` values of volatility
    there is a starting mix. Returns are one row per date, so the windows are small.
    """
    w = Window.orderBy(time)
    full = w.rowsBetween(-(vol_rows - 1), 0)
    x = cut(sleeves, "sleeves").withColumn("_v", F.when(F.count("mkt").over(full) >= vol_rows, F.stddev_samp("mkt").over(full)))
    known, spread = w.rowsBetween(-span, -1), w.rowsBetween(-spread_rows, -1)
    x = x.withColumns({
        "_now": F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_seen": F.count("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "_high": F.percentile("_v", F.lit(STRESS_QUANTILE)).over(known),
        "_cheap": (F.count(F.lit(1)).over(spread) >= spread_rows) & (F.sum("value").over(spread) < F.sum("quality").over(spread)),
    })
    off = ((F.col("_now") >= F.col("_high")) | (F.col(regime) == "high_vol_stress")) & (F.col(regime) != "uncertain")
    on = F.col(regime) == "low_vol"
    started = F.col("_seen") >= least
    table = F.when(~started, "start").when(off, "risk_off").when(on & ~F.col("_cheap"), "risk_on").when(F.col("_cheap"), "value_cheap").otherwise("neutral")
    state = F.when(started & off, "risk_off").when(started & on, "risk_on").otherwise("neutral")
    x = x.withColumns({"_table": table, "state": state})
    weight = {s: F.element_at(F.create_map(*[v for t, row in WEIGHTS.items() for v in (F.lit(t), F.lit(row[i]))]), F.col("_table")) for i, s in enumerate(SLEEVES)}
    x = x.withColumns({f"w_{s}": c for s, c in weight.items()})
    ret = sum((F.col(f"w_{s}") * F.coalesce(s, F.lit(0.0)) for s in SLEEVES), F.lit(0.0))
    return x.select(time, "state", regime, *[f"w_{s}" for s in SLEEVES], ret.alias("ret"), F.col("defensive").alias("static"))


