"""Performance, tails, gaps, concentration and sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import div, over, so_far
from tessera.operators.quantiles import quantiles
from tessera.operators.ranks import with_pct_ranks
from tessera.scratch import cut


def ann_stats(rets: DataFrame, by: list[str], r: str, rf: float = 0.04, periods: int = 252) -> DataFrame:
    """A10: annualised return, volatility and Sharpe ratio."""
    g = rets.groupBy(*by).agg((F.avg(r) * periods).alias("ann_ret"), (F.stddev_samp(r) * periods**0.5).alias("ann_vol"))
    return g.withColumn("sharpe", div(F.col("ann_ret") - rf, F.col("ann_vol")))


def full_metrics(rets: DataFrame, by: list[str], time: str, r: str, trades: DataFrame | None = None, pnl: str | None = None, year: int = 252, least: int = 5) -> DataFrame:
    """Yearly return and volatility, Sharpe, Sortino and Calmar ratios, the deepest drawdown of exp(cumulated returns), turnover and n; hit rate and profit factor of the trades (by, pnl), null without trades or losses. Groups of fewer than ``least`` returns are left out."""
    w = so_far(by, time)
    x = rets.where(F.col(r).isNotNull()).withColumn("_c", F.exp(F.sum(r).over(w)))
    x = x.withColumn("_dd", F.col("_c") / F.max("_c").over(w) - 1)
    ret, root = F.avg(r) * year, year**0.5
    g = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ret.alias("ann_ret"), (F.stddev_samp(r) * root).alias("ann_vol"), div(ret, F.stddev_samp(r) * root).alias("sharpe"), div(ret, F.stddev_samp(F.when(F.col(r) < 0, F.col(r))) * root).alias("sortino"), F.min("_dd").alias("max_dd"), F.when(F.min("_dd") < 0, div(ret, F.abs(F.min("_dd")))).alias("calmar"), (F.avg(F.abs(r)) * year).alias("turnover")).where(F.col("n") >= least)
    if trades is None:
        return g.withColumns({"hit_rate": F.lit(None).cast("double"), "profit_factor": F.lit(None).cast("double")})
    p = F.col(pnl)
    t = trades.where(p.isNotNull()).groupBy(*by).agg(F.avg((p > 0).cast("double")).alias("hit_rate"), div(F.sum(F.when(p > 0, p)), F.abs(F.sum(F.when(p < 0, p)))).alias("profit_factor"))
    return g.join(t, by, "left")


def level_stats(levels: DataFrame, by: list[str], time: str, level: str, periods: int = 12) -> DataFrame:
    """Total return, compound growth, volatility, Sharpe ratio and drawdown of a level series."""
    dd = levels.withColumns({"_dd": F.col(level) / F.max(level).over(so_far(by, time)) - 1, "_r": div(F.col(level), F.lag(level).over(over(by, time))) - 1})
    g = dd.groupBy(*by).agg(div(F.max_by(level, time), F.min_by(level, time)).alias("_x"), F.count(F.lit(1)).alias("n"), F.min("_dd").alias("max_dd"), (F.stddev_samp("_r") * periods**0.5).alias("vol"), (F.avg("_r") * periods).alias("_ret"))
    g = g.withColumn("sharpe", div(F.col("_ret"), F.col("vol"))).drop("_ret")
    g = g.withColumns({"total": F.col("_x") - 1, "cagr": F.when(F.col("n") > 1, F.pow("_x", F.lit(float(periods)) / (F.col("n") - 1)) - 1)}).drop("_x")
    return g.withColumn("calmar", F.when(F.col("max_dd") < 0, F.col("cagr") / F.abs("max_dd")))


def basket_risk(rets: DataFrame, members: DataFrame, entity: str, basket: str, time: str, r: str) -> DataFrame:
    """Volatility and drawdown of the equal-weight basket, mean member volatility and mean beta to the basket."""
    m = rets.where(F.col(r).isNotNull()).join(members, entity)
    ew = m.groupBy(basket, time).agg(F.avg(r).alias("_b"))
    path = ew.withColumn("_l", F.exp(F.sum(F.log1p("_b")).over(so_far(basket, time)))).withColumn("_dd", F.col("_l") / F.max("_l").over(so_far(basket, time)) - 1)
    whole = path.groupBy(basket).agg((F.stddev_samp("_b") * 252**0.5).alias("vol"), F.min("_dd").alias("max_dd"))
    each = m.join(ew, [basket, time]).groupBy(basket, entity).agg(F.stddev_samp(r).alias("_v"), F.when(F.var_samp("_b") > 0, div(F.covar_samp(r, "_b"), F.var_samp("_b"))).alias("_beta"))
    return whole.join(each.groupBy(basket).agg((F.avg("_v") * 252**0.5).alias("member_vol"), F.avg("_beta").alias("beta"), F.count(F.lit(1)).alias("n")), basket)


def tail_loss(rets: DataFrame, by: list[str], r: str, q: float = 0.05) -> DataFrame:
    """Value at risk and expected shortfall at q."""
    cut = rets.where(F.col(r).isNotNull()).groupBy(*by).agg(F.percentile(r, F.lit(q)).alias("var"))
    return rets.join(cut, by).groupBy(*by).agg(F.first("var").alias("var"), F.avg(F.when(F.col(r) <= F.col("var"), F.col(r))).alias("es"), F.avg(r).alias("mean"), F.min(r).alias("worst"))


def hill(rets: DataFrame, by: list[str], r: str, share: float = 0.1, least: int = 5) -> DataFrame:
    """Hill index over the largest absolute returns: k / sum(ln(x / x_k))."""
    x = rets.select(*by, F.abs(r).alias("_x")).where("_x > 0")
    part = Window.partitionBy(*by)
    x = x.withColumn("_rn", F.row_number().over(part.orderBy(F.desc("_x")))).withColumn("_n", F.count(F.lit(1)).over(part))
    k = F.least(F.greatest(F.lit(least), F.floor(F.lit(share) * F.col("_n"))), F.col("_n") - 1)
    top = x.withColumn("_k", k).where("_rn <= _k")
    g = top.groupBy(*by).agg(F.max("_k").alias("k"), F.min("_x").alias("_xk"), F.sum(F.log("_x")).alias("_s"))
    return g.select(*by, "k", div(F.col("k").cast("double"), F.col("_s") - F.col("k") * F.log("_xk")).alias("alpha"))


#: Two-sided normal tail beyond 3, 4 and 5 deviations.
NORMAL_TAIL = {3: 0.0026997960632601866, 4: 6.334248366623973e-05, 5: 5.733031437583892e-07}


def tail_table(rets: DataFrame, by: list[str], r: str) -> DataFrame:
    """Share beyond 3, 4, 5 population deviations over the normal share, and the corrected sample excess kurtosis."""
    s = rets.groupBy(*by).agg(F.avg(r).alias("_m"), F.stddev_pop(r).alias("_s"), F.kurtosis(r).alias("_g"), F.count(r).alias("n"))
    z = rets.join(s, by).withColumn("_z", F.abs(div(F.col(r) - F.col("_m"), F.col("_s"))))
    g = z.groupBy(*by).agg(*[F.avg((F.col("_z") > k).cast("double")).alias(f"p{k}") for k in NORMAL_TAIL], F.first("_g").alias("_g"), F.first("n").alias("n"))
    n = F.col("n").cast("double")
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g") + 6))
    return g.select(*by, *[f"p{k}" for k in NORMAL_TAIL], *[(F.col(f"p{k}") / v).alias(f"x{k}") for k, v in NORMAL_TAIL.items()], kurt.alias("kurtosis"))


def sample_kurtosis(x: str) -> Column:
    """Excess kurtosis with the sample correction, as an aggregate; null for fewer than four values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def weighted_ranks(df: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """Sum of the weighted percentile ranks of the columns that df has, weights renormalised to those; a missing value ranks 0.5."""
    used = {c: w for c, w in weights.items() if c in df.columns}
    ranked = with_pct_ranks(df, {f"_p_{c}": c for c in used})
    total = sum((w * F.coalesce(F.col(f"_p_{c}"), F.lit(0.5)) for c, w in used.items()), F.lit(0.0)) / sum(used.values())
    return ranked.withColumn(name, total).drop(*[f"_p_{c}" for c in used])


def gaps(panel: DataFrame, entity: str, time: str, opened: str, close: str, count: str | None = None) -> DataFrame:
    """Mean and deviation of overnight gaps, deviation of returns, the gaps' variance share, how often they exceed 3 and 5 %, the largest in size and the lowest; with ``count``, how many gaps there are under that name."""
    w = over(entity, time)
    before = F.lag(close).over(w)
    g = panel.withColumn("_gap", div(F.col(opened), before) - 1).withColumn("_ret", div(F.col(close), before) - 1)
    share = div(F.var_samp("_gap"), F.var_samp("_ret"))
    return g.groupBy(entity).agg(F.stddev_samp("_gap").alias("gap_std"), F.stddev_samp("_ret").alias("ret_std"), share.alias("variance_share"), F.avg("_gap").alias("mean_gap"), F.avg((F.abs("_gap") > 0.03).cast("double")).alias("over_3"), F.max(F.abs("_gap")).alias("largest"), F.avg((F.abs("_gap") > 0.05).cast("double")).alias("over_5"), F.min("_gap").alias("worst"), *([F.count("_gap").alias(count)] if count else []))


def concentration(weights: DataFrame, by: list[str], w: str, entity: str, means: list[str] | None = None) -> DataFrame:
    """Herfindahl index, effective number, largest and three largest weights of each portfolio, and the weighted sums of ``means`` (liquidity, beta)."""
    part = Window.partitionBy(*by)
    x = weights.withColumn("_w", div(F.col(w), F.sum(w).over(part)))
    x = x.withColumn("_rn", F.row_number().over(part.orderBy(F.desc("_w"), entity)))
    g = x.groupBy(*by).agg(F.sum(F.col("_w") ** 2).alias("hhi"), F.max("_w").alias("top1"), F.sum(F.when(F.col("_rn") <= 3, F.col("_w"))).alias("top3"), *[F.sum(F.col("_w") * F.col(c)).alias(c) for c in means or []])
    return g.withColumn("effective", div(F.lit(1.0), F.col("hhi")))


def kelly(mu: Column, sigma: Column, rate: Column) -> Column:
    """Continuous fraction (mu - r) / sigma^2."""
    return div(mu - rate, sigma * sigma)


def binary_kelly(p: Column, odds: Column) -> Column:
    return p - div(1 - p, odds)


def start_rows(spark, entities: DataFrame, entity: str, paths: int, blocks: int, block: int, seed: int) -> DataFrame:
    """(entity, path, block number, first row): seeded by MD5, so a retried task draws the same blocks, and so does another engine."""
    grid = entities.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1)))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    room = F.greatest(F.col("n") - block + 1, F.lit(1))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(entity).cast("string"), F.col("path").cast("string"), F.col("block").cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")
    return grid.withColumn("start", F.pmod(draw, room) + 1)


def bootstrap(spark, rets: DataFrame, entity: str, time: str, r: str, paths: int, blocks: int, block: int, seed: int, ruin: float = 0.5, drop: float = 0.2) -> DataFrame:
    """Share of block-bootstrap paths whose level falls below ``ruin`` or by ``drop`` from its peak, per entity."""
    w = over(entity, time)
    numbered = rets.where(F.col(r).isNotNull()).select(entity, F.row_number().over(w).alias("_rn"), F.col(r).alias("_r"))
    sizes = numbered.groupBy(entity).agg(F.max("_rn").alias("n"))
    picks = start_rows(spark, sizes, entity, paths, blocks, block, seed).withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    drawn = picks.withColumn("_rn", (F.col("start") + F.col("_step")).cast("int")).join(numbered, [entity, "_rn"])
    path = Window.partitionBy(entity, "path").orderBy("block", "_step").rowsBetween(Window.unboundedPreceding, 0)
    level = drawn.withColumn("_l", F.exp(F.sum(F.log1p(F.greatest(F.col("_r"), F.lit(-0.999999)))).over(path)))
    level = level.withColumn("_dd", F.col("_l") / F.greatest(F.max("_l").over(path), F.lit(1.0)) - 1)
    worst = level.groupBy(entity, "path").agg(F.min("_l").alias("low"), F.min("_dd").alias("dd"))
    return worst.groupBy(entity).agg(F.avg((F.col("low") < ruin).cast("double")).alias("p_ruin"), F.avg((F.col("dd") < -drop).cast("double")).alias("p_drop"), F.count(F.lit(1)).alias("paths"))


#: Direction shares up to which a forecast is weak or mixed.
WEAK, MIXED = 0.45, 0.55


def reliability_tier(direction: Column) -> Column:
    """Weak, mixed or strong by the share of right directions; null without one."""
    return F.when(direction <= WEAK, "weak").when(direction <= MIXED, "mixed").when(direction.isNotNull(), "strong")


def turnover_cap(weights: DataFrame, by: list[str], target: str, current: str, band: float, name: str) -> DataFrame:
    """Targets held within ``band`` times the current weight on either side, not below 0, and made to sum to 1 again per group; a band of 1 or more changes nothing."""
    if band >= 1:
        return weights.withColumn(name, F.col(target))
    now = F.col(current)
    held = F.least(F.greatest(F.col(target), F.greatest(now - band * now, F.lit(0.0))), now + band * now)
    total = F.sum(held).over(Window.partitionBy(*by))
    return weights.withColumn(name, F.when(total > 0, held / total).otherwise(F.col(target)))


#: Quantiles of volatility and of the gap share, and the share of gaps that makes a name convex by itself.
SAFE_VOL, CONVEX_VOL, SAFE_GAP, CONVEX_GAP = 0.25, 0.80, 0.90, 1.2


def barbell(names: DataFrame) -> DataFrame:
    """(columns of names, bucket): safe, middle or convex by the places of ``vol`` and ``gap_share`` among all names."""
    x = cut(names, "names")
    q = quantiles(x, [], "vol", {"_vq": SAFE_VOL, "_vh": CONVEX_VOL}).join(F.broadcast(quantiles(x, [], "gap_share", {"_gh": SAFE_GAP})))  # both are one row
    safe = (F.col("vol") <= F.col("_vq")) & (F.col("gap_share") <= F.col("_gh"))
    convex = (F.col("vol") >= F.col("_vh")) | (F.col("gap_share") > CONVEX_GAP)
    return x.join(F.broadcast(q)).withColumn("bucket", F.when(safe, "safe").when(convex, "convex").otherwise("middle")).drop("_vq", "_vh", "_gh")


def gap_events(panel: DataFrame, entity: str, time: str, opened: str, close: str, least: float = 0.05) -> DataFrame:
    """(entity, time, gap_pct, close_pct) of every gap over ``least`` in size."""
    before = F.lag(close).over(over(entity, time))
    g = panel.select(entity, time, (100 * (div(F.col(opened), before) - 1)).alias("gap_pct"), (100 * (div(F.col(close), before) - 1)).alias("close_pct"))
    return g.where(F.abs("gap_pct") > 100 * least)


def volatility_steps(panel: DataFrame, entity: str, time: str, price: str, windows: DataFrame, base: int = 9000, rows: int = 1260, ref: int = 200, floor: int = 2000, ceil: int = 20000, year: int = 252) -> DataFrame:
    """(entity, steps): base times an entity's volatility over the median one and the root of its windows over ``ref``, rounded and held between floor and ceil; base where there is no volatility.

    Volatility is that of the last ``rows`` log returns between prices above 1, of which there must be ten, with three
    returns. windows: (entity, windows), all entities that get steps.
    """
    p = panel.where(F.col(price) > 1).withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy(entity)), "_r": F.log(div(F.col(price), F.lag(price).over(over(entity, time))))}).where("_r IS NOT NULL")
    p = p.withColumn("_rn", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(time)))).where(F.col("_rn") <= rows)
    v = cut(p.groupBy(entity).agg(F.when((F.max("_n") >= 10) & (F.count(F.lit(1)) >= 3), F.stddev_samp("_r") * year**0.5).alias("_v")), "volatility")
    told = windows.join(v, entity, "left").join(F.broadcast(quantiles(v, [], "_v", {"_med": 0.5})), how="left")  # one row
    steps = F.bround(base * (F.col("_v") / F.col("_med")) * F.sqrt(F.col("windows") / ref))
    return told.select(entity, F.when((F.col("_med") > 0) & F.col("_v").isNotNull(), F.least(F.greatest(steps, F.lit(float(floor))), F.lit(float(ceil)))).otherwise(F.lit(float(base))).cast("long").alias("steps"))
