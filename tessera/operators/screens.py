"""Multi-leg screens: predicates, thresholds, scores and decisions as column expressions over dated ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import clip, div

#: Thresholds of the six legs by regime.
LEGS = {"roe": ("roe", ">="), "roic": ("roic", ">="), "de": ("de", "<="), "ev": ("ev", "<="), "pb": ("pb", "<="), "mca": ("mca", "<=")}
THRESHOLDS = {
    "normal": {"roe": 0.15, "roic": 0.15, "de": 1.0, "ev": 9.0, "pb": 1.5, "mca": 0.5},
    "low_vol": {"roe": 0.15, "roic": 0.15, "de": 1.0, "ev": 12.0, "pb": 2.0, "mca": 0.8},
    "high_vol_stress": {"roe": 0.15, "roic": 0.15, "de": 0.8, "ev": 8.0, "pb": 1.3, "mca": 0.45},
    "uncertain": {"roe": 0.15, "roic": 0.15, "de": 1.0, "ev": 9.0, "pb": 1.5, "mca": 0.5},
}


def policy(spark) -> DataFrame:
    """The thresholds as rows, one per regime."""
    return spark.createDataFrame([(k, *v.values()) for k, v in THRESHOLDS.items()], "regime string, " + ", ".join(f"t_{x} double" for x in LEGS))


def leg(name: str, limit: Column | float | None = None) -> Column:
    """One leg; a null ratio fails it."""
    c, op = LEGS[name]
    limit = F.lit(THRESHOLDS["normal"][name]) if limit is None else limit if isinstance(limit, Column) else F.lit(limit)
    return F.coalesce(F.col(c) >= limit if op == ">=" else F.col(c) <= limit, F.lit(False))


def with_legs(df: DataFrame, limits: dict[str, Column] | None = None) -> DataFrame:
    """pass_<leg> flags, n_failed, failed_legs (comma-joined) and dual_pass."""
    limits = limits or {}
    out = df.withColumns({f"pass_{k}": leg(k, limits.get(k)) for k in LEGS})
    failed = F.array_compact(F.array(*[F.when(~F.col(f"pass_{k}"), F.lit(k)) for k in LEGS]))
    return out.withColumn("n_failed", F.size(failed)).withColumn("failed_legs", F.concat_ws(",", failed)).withColumn("dual_pass", F.col("n_failed") == 0)


def gaps(limits: dict[str, Column] | None = None) -> dict[str, Column]:
    """Signed distance to each threshold, positive where the leg passes with room; null stays null."""
    limits = limits or {k: F.lit(v) for k, v in THRESHOLDS["normal"].items()}
    return {f"{k}_gap": (F.col(c) - limits[k]) if op == ">=" else (limits[k] - F.col(c)) for k, (c, op) in LEGS.items()}


def select_regime(posteriors: Column, regime: Column, soft: float = 0.7) -> Column:
    """The label, or "uncertain" where the largest posterior is below soft; null or unknown labels fall back to normal."""
    known = F.coalesce(F.when(regime.isin(*THRESHOLDS), regime), F.lit("normal"))
    return F.when(F.array_max(posteriors) < soft, "uncertain").otherwise(known)


def inverse(x: Column, limit: float) -> Column:
    """1 up to the limit, falling to 0 at 2.5 times it; 0 for null."""
    return F.when(x.isNull(), 0.0).when(x <= limit, 1.0).otherwise(clip(1 - (x - limit) / (limit * 1.5), 0, 1))


def value_score() -> Column:
    """P17 and the value part of P15."""
    t = THRESHOLDS["normal"]
    return 0.4 * inverse(F.col("ev"), t["ev"]) + 0.3 * inverse(F.col("pb"), t["pb"]) + 0.3 * inverse(F.col("mca"), t["mca"])


#: The weights and limits of the scores below, of composite() and of the decision labels.


def quality_part() -> Column:
    """The quality part of P15: weights .35, .35, .15, .15; a null ratio gives nothing."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return 0.35 * z(clip(F.col("roe") / 0.25, 0, 1)) + 0.35 * z(clip(F.col("roic") / 0.25, 0, 1)) + 0.15 * z(clip(1 - F.col("de") / 2, 0, 1)) + 0.15 * z(F.col("stab"))


def quality_score() -> Column:
    """Weights .30, .30, .15, .15, .10; null returns give 0, other null ratios a neutral 0.5. Not the weights of P15."""
    n = lambda c, v: F.coalesce(c, F.lit(v))
    return 0.30 * n(clip(F.col("roe") / 0.25, 0, 1), 0.0) + 0.30 * n(clip(F.col("roic") / 0.25, 0, 1), 0.0) + 0.15 * n(clip(1 - F.col("de") / 2, 0, 1), 0.5) + 0.15 * n(F.col("stab"), 0.5) + 0.10 * n(clip(F.col("ic") / 15, 0, 1), 0.5)


def composite(q: Column, v: Column) -> Column:
    return 0.55 * q + 0.45 * v


def leverage_flag() -> Column:
    """What a low market-to-assets ratio rests on."""
    low = F.col("mca") <= THRESHOLDS["normal"]["mca"]
    de, ic = F.col("de"), F.col("ic")
    return F.when(~F.coalesce(low, F.lit(False)), "").when(de > 1.0, "levered-assets").when((de <= 0.5) & (ic.isNull() | (ic >= 5)), "cheap-assets").when(de <= 1.0, "mixed-assets").otherwise("low-MCA")


def leverage_adjusted(score: Column, flag: Column) -> Column:
    return F.when(flag == "cheap-assets", F.least(F.lit(1.0), score + 0.03)).when(flag == "levered-assets", F.greatest(F.lit(0.0), score - 0.10)).when(flag == "low-MCA", F.greatest(F.lit(0.0), score - 0.02)).otherwise(score)


def size_cap(score: Column, target: Column) -> Column:
    """Weight band by score, held to a target weight where there is one."""
    band = F.when(score >= 0.75, 0.12).when(score >= 0.60, 0.08).when(score >= 0.45, 0.05).otherwise(0.03)
    return F.when(target.isNull(), band).otherwise(F.least(band, target))


def size_action(score: Column) -> Column:
    return F.when(score >= 0.75, "prefer_add").when(score >= 0.70, "hold_or_add").when(score >= 0.50, "hold").otherwise("reduce_or_avoid")


def trend_demotion(history: DataFrame, entity: str, time: str) -> DataFrame:
    """The demotion of P20: of at least 4 complete rows, two of three pillars fell by 30 % (returns) or 50 % (stability)."""
    full = history.where("roe IS NOT NULL AND roic IS NOT NULL AND stab IS NOT NULL")
    ends = full.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), *[f(c, time).alias(f"{c}_{p}") for c in ("roe", "roic", "stab") for p, f in (("a", F.min_by), ("z", F.max_by))])
    fell = lambda c, k: ((F.col(f"{c}_a") > 0) & (F.col(f"{c}_z") != 0) & (F.col(f"{c}_z") < F.col(f"{c}_a") * k)).cast("int")
    return ends.select(entity, ((F.col("n") >= 4) & (fell("roe", 0.7) + fell("roic", 0.7) + fell("stab", 0.5) >= 2)).alias("demoted"))


def decide(df: DataFrame) -> DataFrame:
    """P20: scores, bonus for passing both sides, leverage adjustment, gates and the decision label. df needs ``demoted``."""
    buffett = leg("roe") & leg("roic") & leg("de")
    trifecta = leg("ev") & leg("pb") & leg("mca")
    out = df.withColumns({"q": quality_score(), "v": value_score(), "buffett": buffett, "trifecta": trifecta, "flag": leverage_flag()})
    score = composite(F.col("q"), F.col("v"))
    score = F.when(F.col("buffett") & F.col("trifecta"), F.least(F.lit(1.0), score + 0.08)).otherwise(score)
    out = out.withColumn("score", leverage_adjusted(score, F.col("flag")))
    dual = F.col("buffett") & F.col("trifecta") & ~F.col("demoted") & F.coalesce(F.col("stab") >= 0.5, F.lit(False)) & ~((F.col("flag") == "levered-assets") & (F.col("ic").isNull() | (F.col("ic") < 5)))
    return out.withColumn("decision", F.when(dual, "INCLUDE_CORE").when(F.col("trifecta") & (F.col("score") >= 0.45), "INCLUDE_VALUE").when(F.col("buffett") & (F.col("score") >= 0.55), "INCLUDE_QUALITY").when(F.col("score") >= 0.50, "SATELLITE").when(F.col("score") >= 0.35, "WATCH").otherwise("AVOID"))


def gap_class() -> Column:
    """Which sides pass."""
    b, t = leg("roe") & leg("roic") & leg("de"), leg("ev") & leg("pb") & leg("mca")
    return F.when(b & t, "dual").when(b, "quality_only").when(t, "value_only").otherwise("neither")


#: Relaxed borders of the candidate screen.
NEAR = {"roe": 0.12, "roic": 0.10, "de": 1.2, "ev": 10.0, "pb": 2.0, "mca": 0.9}


def near_dual() -> Column:
    """Passes the relaxed borders, or both sides."""
    near, both = F.lit(True), F.lit(True)
    for k, v in NEAR.items():
        near = near & leg(k, v)
    for k in LEGS:
        both = both & leg(k)
    return near | both


def dupont(df: DataFrame) -> DataFrame:
    """Equity multiplier, the return without leverage, the boost and its share, and what a return of 15 % or more rests on: a multiplier up to 1.5, up to 2 or above."""
    em = 1 + F.col("de")
    out = df.withColumns({"multiplier": em, "operating": div(F.col("roe"), em)})
    out = out.withColumn("boost", F.col("roe") - F.col("operating")).withColumn("boost_share", div(F.col("boost"), F.col("roe")))
    return out.withColumn("roe_class", F.when(F.col("roe").isNull() | F.col("de").isNull(), "unknown").when(F.col("roe") < 0, "negative").when(F.col("roe") < 0.15, "modest").when(em <= 1.5, "high_ops").when(em > 2.0, "leverage_driven").otherwise("mixed"))


def stressed(df: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Df under each scenario's thresholds (scenario, t_<leg>; a null threshold drops the leg). The scenario list is a handful of rows."""
    both = df.join(F.broadcast(scenarios))
    return both.withColumns({f"pass_{k}": F.col(f"t_{k}").isNull() | leg(k, F.col(f"t_{k}")) for k in LEGS}).withColumn("all_pass", F.expr(" AND ".join(f"pass_{k}" for k in LEGS)))
