"""Group statistics, leave-one-out ranks, fundamental trends and factor composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import div, pct_rank, safe_corr
from tessera.operators.keys import meet
from tessera.operators.quantiles import quantiles
from tessera.operators.ranks import with_pct_ranks, with_rank
from tessera.scratch import cut, ordered_prefix


def group_summary(df: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """N, mean, median, population deviation and quartiles of each metric in each group."""
    u = cut(df.unpivot(group, metrics, "metric", "v").where("v IS NOT NULL"), "metrics")
    g = u.groupBy(group, "metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return meet(g, quantiles(u, [group, "metric"], "v", {"median": 0.5, "p25": 0.25, "p75": 0.75}), [group, "metric"])


def leave_one_out_rank(df: DataFrame, group: str | list[str], x: str, name: str, low_is_good: bool = False) -> DataFrame:
    """Share of the other members with a strictly lower value (higher, if low is good); null with no other member."""
    part = Window.partitionBy(*([group] if isinstance(group, str) else group))
    order = F.desc(x) if low_is_good else F.asc(x)
    return df.where(F.col(x).isNotNull()).withColumn(name, div(F.rank().over(part.orderBy(order)) - 1.0, F.count(x).over(part) - 1))


def trends(history: DataFrame, entity: str, time: str, metrics: list[str], least: int = 4) -> DataFrame:
    """Per entity and metric the slope over the entity's rows, the total change along it, that over the first value (relative), and by how much the last two values' mean exceeds the first two's (shift, relative).

    Entities and metrics of fewer than ``least`` rows or values are left out. The slope divides a sample covariance by a
    population variance, as the reference's results do, and is rounded to 12 decimals, so that a level series has none.
    """
    w = Window.partitionBy(entity)
    u = history.withColumns({"_i": F.row_number().over(w.orderBy(time)).cast("double"), "_rows": F.count(F.lit(1)).over(w)}).where(F.col("_rows") >= least)
    u = u.unpivot([entity, "_i"], metrics, "metric", "v").where("v IS NOT NULL")
    part = Window.partitionBy(entity, "metric")
    u = u.withColumns({"_k": F.row_number().over(part.orderBy("_i")), "n": F.count(F.lit(1)).over(part)}).where(F.col("n") >= least)
    mean = lambda c: F.avg(F.when(c, F.col("v")))
    g = u.groupBy(entity, "metric").agg(F.max("n").alias("n"), F.round(div(F.covar_samp("_i", "v"), F.var_pop("_i")), 12).alias("slope"), F.min_by("v", "_i").alias("first"), F.max_by("v", "_i").alias("last"), (F.max("_i") - F.min("_i")).alias("_span"), mean(F.col("_k") <= 2).alias("_early"), mean(F.col("_k") > F.col("n") - 2).alias("_recent"))
    g = g.withColumn("change", F.col("slope") * F.col("_span"))
    return g.withColumns({"relative": div(F.col("change"), F.col("first")), "shift": div(F.col("_recent") - F.col("_early"), F.col("_early"))}).drop("_span", "_early", "_recent")


#: Relative shift of a turn, slope of a strong trend, and how many metrics make a signal.
TURN, STRONG = 0.05, 0.01
TURNS, STRONGS = 2, 3
#: Shares of peers below from which an entity leads or lags.
LEADER, LAGGARD = 0.75, 0.25


def trend_flags(trends_: DataFrame) -> DataFrame:
    """Recovering (falling, but lately higher by over 5 %), deteriorating (the reverse) and strong (a slope over 0.01 in size whose sign the shift shares)."""
    s, shift = F.col("slope"), F.col("shift")
    known = lambda c: F.coalesce(c, F.lit(False))
    return trends_.withColumns({"recovering": known((s < 0) & (shift > TURN)), "deteriorating": known((s > 0) & (shift < -TURN)), "strong": known((F.abs(s) > STRONG) & (F.signum(s) == F.signum(shift)))})


def assembled_signals(entities: DataFrame, entity: str, flags: DataFrame, ranks: DataFrame, betas: DataFrame) -> DataFrame:
    """One row per entity: counts of its metrics' flags and the signal they give, its best group with the ranks there, and its betas over all groups.

    flags: (entity, recovering, deteriorating, strong) per metric; ranks: (entity, group, ret_rank, vol_rank, ratio_rank)
    per group, the best one by ratio_rank, then by name; betas: (entity, beta, off_median, high, low) per group.
    """
    f = flags.groupBy(entity).agg(*[F.count_if(c).cast("int").alias(c) for c in ("recovering", "deteriorating", "strong")])
    order = F.struct(F.col("ratio_rank").isNotNull(), F.col("ratio_rank"))
    first = Window.partitionBy(entity).orderBy(order.desc(), "group")
    best = ranks.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select(entity, F.col("group").alias("best_group"), *[F.col(c).alias(f"best_{c}") for c in ("ret_rank", "vol_rank", "ratio_rank")])
    b = betas.groupBy(entity).agg(F.avg("beta").alias("mean_beta"), F.avg("off_median").alias("mean_off_median"), F.bool_or("high").alias("high_any"), F.bool_or("low").alias("low_any"))
    out = entities.join(f, entity, "left").join(best, entity, "left").join(b, entity, "left").fillna(0, ["recovering", "deteriorating", "strong"])
    trend = F.when(F.col("recovering") >= TURNS, "RECOVERING").when(F.col("deteriorating") >= TURNS, "DETERIORATING").when(F.col("strong") >= STRONGS, "STRONG_TREND").otherwise("NEUTRAL")
    peer = F.when(F.col("best_ratio_rank") >= LEADER, "PEER_LEADER").when(F.col("best_ratio_rank") <= LAGGARD, "PEER_LAGGARD").otherwise("PEER_AVERAGE")
    beta = F.when(F.col("high_any"), "HIGH_BETA").when(F.col("low_any"), "LOW_BETA").otherwise("NEUTRAL_BETA")
    return out.withColumns({"fundamental_signal": trend, "peer_signal": peer, "beta_signal": beta})


def quintile(df: DataFrame, part: str, x: str, n: int = 5) -> DataFrame:
    """Bucket by percentile edges with (low, high] bins, the first closed on both sides; equal edges make one bin."""
    edges = df.groupBy(part).agg(F.array_distinct(F.percentile(x, F.array(*[F.lit(k / n) for k in range(n + 1)]))).alias("_e"))
    place = F.size(F.filter("_e", lambda e: e < F.col(x)))
    return df.join(edges, part).withColumn("bucket", F.when(F.col(x).isNotNull(), F.greatest(place, F.lit(1)))).drop("_e")


def even_buckets(df: DataFrame, order: list[str], n: int = 5, name: str = "bucket") -> DataFrame:
    """df with buckets 1..n of equal number along a total order, from range partitions and their counts."""
    placed = ordered_prefix(df, order, [], "buckets")
    total = placed.agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(F.broadcast(total)).withColumn(name, (1 + F.floor(F.col("pos") * n / F.col("_n"))).cast("int")).drop("pos", "_n")


def residual_momentum(rets: DataFrame, entity: str, time: str, r: str, market: str, rows: int, least: int) -> DataFrame:
    """Mean of the last ``rows`` returns less beta times the market's, times rows; beta over all dates, null with ``least`` or fewer."""
    x = rets.where(F.col(r).isNotNull() & F.col(market).isNotNull()).withColumn("_rn", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(time))))
    near = lambda c: F.when(F.col("_rn") <= rows, F.col(c))
    g = x.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"), div(F.covar_samp(r, market), F.var_samp(market)).alias("beta"), F.avg(near(r)).alias("_r"), F.avg(near(market)).alias("_m"))
    return g.where(F.col("_n") > least).select(entity, "beta", ((F.col("_r") - F.col("beta") * F.col("_m")) * rows).alias("resid"))


def exposure_deviation(ranked: DataFrame, by: str, group: str, chosen: Column) -> DataFrame:
    """Per date the mean over the chosen rows' groups of how far a group's share of them lies from its share of all."""
    n = ranked.groupBy(by, group).agg(F.count(F.lit(1)).alias("_a"), F.count_if(chosen).alias("_c"))
    part = Window.partitionBy(by)
    n = n.withColumn("_off", F.abs(div(F.col("_c"), F.sum("_c").over(part)) - F.col("_a") / F.sum("_a").over(part)))
    return n.where("_c > 0").groupBy(by).agg(F.avg("_off").alias("exposure_dev"))


def rank_ic(df: DataFrame, by: list[str], signal: str, target: str) -> DataFrame:
    """Spearman (average ranks) and Pearson correlation of signal and target per group; null where either is constant."""
    both = df.where(F.col(signal).isNotNull() & F.col(target).isNotNull())
    part = Window.partitionBy(*by)
    ranked = both.withColumns({"_s": pct_rank(F.col(signal), part), "_t": pct_rank(F.col(target), part)})
    return ranked.groupBy(*by).agg(safe_corr(F.col("_s"), F.col("_t")).alias("spearman"), safe_corr(F.col(signal), F.col(target)).alias("pearson"), F.count(F.lit(1)).alias("n"))


#: Fixed value: dates of history at which a family's weight counts in full; more count more.
FULL_HISTORY = 504


def family_weights(df: DataFrame, family: str, time: str, signal: str, target: str, aged: bool = False) -> DataFrame:
    """Mean rank correlation (ic) of each family's signal with the target over n dates, and its share (weight) of those above 0; ``aged``: times the root of n / FULL_HISTORY."""
    ic = rank_ic(df, [family, time], signal, target).groupBy(family).agg(F.avg("spearman").alias("ic"), F.count("spearman").alias("n"))
    up = F.greatest("ic", F.lit(0.0)) * (F.sqrt(F.col("n") / FULL_HISTORY) if aged else F.lit(1.0))
    return ic.withColumn("weight", F.coalesce(div(up, F.sum(up).over(Window.partitionBy())), F.lit(0.0)))  # one row per family


def family_composite(scores: DataFrame, entity: str, families: list[str], weights: DataFrame) -> DataFrame:
    """(entity, composite, rank): weighted mean of the families' percentile ranks over all entities, 0.5 where an entity has no value; families without weight don't count, and without any the composite is null.

    weights: (family, weight), one row per family, as ``family_weights`` gives them.
    """
    ranked = with_pct_ranks(cut(scores.select(entity, *families), "scores"), {f"_p_{f}": f for f in families})
    held = weights.agg(*[F.coalesce(F.max(F.when((F.col("family") == f) & (F.col("weight") > 0), F.col("weight"))), F.lit(0.0)).alias(f"_w_{f}") for f in families])
    total = sum((F.col(f"_w_{f}") for f in families), F.lit(0.0))
    mixed = sum((F.col(f"_w_{f}") * F.coalesce(f"_p_{f}", F.lit(0.5)) for f in families), F.lit(0.0))
    out = ranked.join(F.broadcast(held)).select(entity, F.round(div(mixed, total), 4).alias("composite"))  # weights are one row
    return with_rank(cut(out, "composite"), "composite")


def average_rolling_beta(rolled: DataFrame, entity: str, group: str, beta: str, time: str, rows: int) -> DataFrame:
    """Mean of the last rolling betas of each entity with the group's median and the quartile flags.

    Flags compare to 12 decimals: entities with equal series lie on a quartile of theirs, not beside it by how their sums were added up.
    """
    w = Window.partitionBy(group, entity).orderBy(F.desc(time))
    last = rolled.where(F.col(beta).isNotNull()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= rows)
    mean = last.groupBy(group, entity).agg(F.avg(beta).alias("mean_beta"))
    q = mean.groupBy(group).agg(F.median("mean_beta").alias("median_beta"), F.percentile("mean_beta", F.lit(0.25)).alias("_a"), F.percentile("mean_beta", F.lit(0.75)).alias("_z"))
    return mean.join(q, group).withColumns({"high": F.round("mean_beta", 12) > F.round("_z", 12), "low": F.round("mean_beta", 12) < F.round("_a", 12)}).drop("_a", "_z")


def surprise_bucket(percent: Column) -> Column:
    """Miss, beat or big_beat (5 % and more) by the surprise in percent."""
    return F.when(percent >= 5.0, "big_beat").when(percent >= 0, "beat").when(percent.isNotNull(), "miss")


#: Shares of the two ranks in the catalyst score, and the percentiles that make momentum hot or cold.
DRIFT_RANK, MOMENTUM_RANK = 0.7, 0.3
HOT, COLD = 0.67, 0.33


def catalyst(df: DataFrame, expected: str, momentum: str) -> DataFrame:
    """Df with score and momentum_flag. The score blends the percentile ranks of the expected drift and of the momentum, 0.5 where one is missing; without an expected drift it is 0."""
    x = with_pct_ranks(cut(df, "events"), {"_e": expected, "_m": momentum})
    half = lambda c: F.coalesce(c, F.lit(0.5))
    score = F.when(F.col(expected).isNotNull(), DRIFT_RANK * half("_e") + MOMENTUM_RANK * half("_m")).otherwise(0.0)
    flag = F.when(F.col(momentum) >= HOT, "hot").when(F.col(momentum) <= COLD, "cold").when(F.col(momentum).isNotNull(), "neutral")
    return x.withColumns({"score": score, "momentum_flag": flag}).drop("_e", "_m")
