"""Rolling statistics over an entity's rows: volatility, beta, drawdown, momentum, anomalies, term structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import div, over, so_far, trailing


def full(value: Column, seen: Column, least: int) -> Column:
    """value where at least so many rows were seen in the frame, else null."""
    return F.when(seen >= least, value)


def rolling_vol(rets: DataFrame, entity: str, time: str, r: str, rows: int, name: str = "vol", scale: float = 252.0) -> DataFrame:
    """Annualised sample deviation of the last rows; null until the frame is full."""
    w = trailing(entity, time, rows)
    return rets.withColumn(name, full(F.stddev_samp(r).over(w), F.count(r).over(w), rows) * scale**0.5)


def rolling_pair(panel: DataFrame, entity: str, time: str, x: str, y: str, rows: int) -> DataFrame:
    """Rolling covariance, beta of x on y and correlation; null until the frame is full or where y is constant."""
    w = trailing(entity, time, rows)
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).over(w)
    cov, vx, vy = F.covar_samp(x, y).over(w), F.var_samp(x).over(w), F.var_samp(y).over(w)
    return panel.withColumns({"cov": full(cov, n, rows), "beta": full(F.when(vy > 0, div(cov, vy)), n, rows), "corr": full(F.when((vx > 0) & (vy > 0), div(cov, F.sqrt(vx * vy))), n, rows)})


def drawdown(panel: DataFrame, entity: str | list[str], time: str, level: str) -> DataFrame:
    """Running peak, drawdown from it and its minimum so far."""
    w = so_far(entity, time)
    out = panel.withColumn("peak", F.max(level).over(w))
    return out.withColumn("dd", div(F.col(level), F.col("peak")) - 1).withColumn("max_dd", F.min("dd").over(w))


def vol_ratio(rets: DataFrame, entity: str, time: str, r: str, short: int, long: int) -> DataFrame:
    """Short over long realised volatility."""
    out = rolling_vol(rolling_vol(rets, entity, time, r, short, "vol_short"), entity, time, r, long, "vol_long")
    return out.withColumn("vol_ratio", div(F.col("vol_short"), F.col("vol_long")))


def true_range(panel: DataFrame, entity: str, time: str, high: str, low: str, close: str) -> DataFrame:
    """W16, first step: the largest of the bar's range and the moves from the close before."""
    before = F.lag(close).over(over(entity, time))
    return panel.withColumn("tr", F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before)))


def features(panel: DataFrame, entity: str, time: str, price: str, qty: str, high: str, low: str, short: int = 5, long: int = 20) -> DataFrame:
    """Log returns over 1 and short rows, moving averages and their ratio, volatility, range, quantity z-score, typical price."""
    w = over(entity, time)
    ws, wl = trailing(entity, time, short), trailing(entity, time, long)
    n_s, n_l = F.count(price).over(ws), F.count(price).over(wl)
    out = panel.withColumns({"lr1": F.log(div(F.col(price), F.lag(price).over(w))), "lr_s": F.log(div(F.col(price), F.lag(price, short).over(w))), "ma_s": full(F.avg(price).over(ws), n_s, short), "ma_l": full(F.avg(price).over(wl), n_l, long)})
    sd = F.stddev_samp(qty).over(wl)
    return out.withColumns({
        "ma_ratio": div(F.col("ma_s"), F.col("ma_l")) - 1, "vol": full(F.stddev_samp("lr1").over(wl), F.count("lr1").over(wl), long),
        "range": div(F.col(high) - F.col(low), F.col(price)), "qty_z": full(F.when(sd > 0, (F.col(qty) - F.avg(qty).over(wl)) / sd), n_l, long), "typical": (F.col(high) + F.col(low) + F.col(price)) / 3,
    })


def anomalies(panel: DataFrame, entity: str, time: str, price: str, qty: str, rows: int = 20, limit: float = 3.0) -> DataFrame:
    """ret_z (log return), resid_z (price less its rolling median, over the residual's deviation), vol_z (quantity), each in the frame that ends at the row; score: the largest in size; is_anomaly: score at or over the limit.

    Frames count from half their rows on (5 at least); a constant frame gives null. market_shock: the date's cross-section
    deviation of returns over its trailing mean of so many dates, one row per date.
    """
    w, least = trailing(entity, time, rows), max(5, rows // 2)
    z = lambda c, mid, n: full(F.when(F.stddev_samp(c).over(w) > 0, (F.col(c) - mid) / F.stddev_samp(c).over(w)), F.count(c).over(w), n)
    out = panel.withColumn("ret", F.log(div(F.col(price), F.lag(price).over(over(entity, time)))))
    seen = F.array_sort(F.collect_list(price).over(w))  # at most ``rows`` values
    n = F.size("_seen")
    middle = (F.get("_seen", F.floor((n - 1) / 2).cast("int")) + F.get("_seen", F.floor(n / 2).cast("int"))) / 2
    out = out.withColumn("_seen", seen).withColumn("_resid", full(F.col(price) - middle, n, least)).drop("_seen")
    out = out.withColumns({"ret_z": z("ret", F.avg("ret").over(w), least), "resid_z": z("_resid", F.lit(0.0), least), "vol_z": z(qty, F.avg(qty).over(w), 5)}).drop("_resid")
    days = out.where("ret IS NOT NULL").groupBy(time).agg(F.stddev_samp("ret").alias("_disp"))
    days = days.select(time, div(F.col("_disp"), F.avg("_disp").over(Window.orderBy(time).rowsBetween(-(rows - 1), 0))).alias("market_shock"))
    out = out.withColumn("score", F.greatest(F.abs("ret_z"), F.abs("resid_z"), F.abs("vol_z"))).withColumn("is_anomaly", F.coalesce(F.col("score") >= limit, F.lit(False)))
    return out.join(days, time, "left")


def term_structure(rets: DataFrame, entity: str | list[str], time: str, r: str, rows: list[int], short: int, mid: int, long: int) -> DataFrame:
    """Yearly volatilities in percent over several horizons (vol_<rows>); slopes from mid to long and from short to mid, whether the former rises (contango) or falls, and the convexity of the three. Null until all windows are full."""
    out = rets
    for k in rows:
        out = rolling_vol(out, entity, time, r, k, f"vol_{k}").withColumn(f"vol_{k}", 100 * F.col(f"vol_{k}"))
    near, middle, far = (F.col(f"vol_{k}") for k in (short, mid, long))
    slope = far - middle
    return out.withColumns({"slope_long": slope, "slope_short": middle - near, "contango": slope > 0, "backwardation": slope < 0, "convexity": (near + far) / 2 - middle})


def skip_return(panel: DataFrame, entity: str, time: str, price: str, far: int, near: int) -> DataFrame:
    """Return from far rows back to near rows back."""
    w = over(entity, time)
    return panel.withColumn("skip", div(F.lag(price, near).over(w), F.lag(price, far).over(w)) - 1)


def recent_percentile(panel: DataFrame, entity: str, time: str, price: str, back: int = 21, rows: int = 252, least: int = 260) -> DataFrame:
    """Per entity the last return over ``back`` rows (now) and its place among the last ``rows`` such returns: the share that lies below it. Entities of fewer than ``least`` rows are left out."""
    w = over(entity, time)
    x = panel.where(F.col(price).isNotNull()).withColumns({"_r": div(F.col(price), F.lag(price, back).over(w)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(entity))}).where((F.col("_n") >= least) & F.col("_r").isNotNull())
    newest = Window.partitionBy(entity).orderBy(F.col(time).desc())
    last = x.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= rows).withColumn("_now", F.first("_r").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return last.groupBy(entity).agg(F.avg((F.col("_r") < F.col("_now")).cast("double")).alias("pctile"), F.max("_now").alias("now"), F.count(F.lit(1)).alias("n"))


def spells(panel: DataFrame, entity: str | list[str], time: str, flag: str) -> DataFrame:
    """Gaps and islands: start, end and length of each run of rows in which flag holds."""
    part = [entity] if isinstance(entity, str) else entity
    w = over(part, time)
    run = panel.withColumn("_rn", F.row_number().over(w)).where(flag).withColumn("_island", F.col("_rn") - F.row_number().over(w))
    return run.groupBy(*part, "_island").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n")).drop("_island")
