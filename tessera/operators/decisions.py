"""Decision ladders and scores over screened rows: inclusion, buy score, views, membership strength, gated forecasts, ratios from statements.

Each ladder or score is a table of conditions, so a row of the table is one condition as a SQL expression over the
columns that the function names. A null condition doesn't hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import div
from tessera.operators import screens

#: The inclusion ladder (condition, candidacy, decision), first that holds; stability below which a dual pass stays out of the core.
STABLE_FOR_CORE = 0.25
INCLUSION = [
    ("dual AND NOT unstable", "INCLUDE", "INCLUDE_CORE"),
    ("dual", "EXCLUDE", "WATCH"),
    ("value", "INCLUDE", "INCLUDE_VALUE"),
    ("quality", "INCLUDE", "INCLUDE_QUALITY"),
    ("n_failed <= 2", "WATCH", "NEAR_DUAL"),
    ("n_failed >= 5", "EXCLUDE", "AVOID"),
    ("true", "WATCH", "WATCH"),
]

#: Terms of the buy score. Of the terms of one name the first that holds counts; a term without reason adds no word.
BUY_TERMS = [
    ("decision", "decision = 'INCLUDE_CORE'", 0.35, "dual_pass_core"),
    ("decision", "decision = 'INCLUDE_VALUE'", 0.20, "value_trifecta"),
    ("decision", "decision = 'INCLUDE_QUALITY'", 0.20, "buffett_quality"),
    ("decision", "decision = 'SATELLITE'", 0.08, "satellite"),
    ("decision", "decision = 'AVOID'", -0.25, "decision_avoid"),
    ("momentum", "momentum > 0.5", 0.20, "strong_momentum"),
    ("momentum", "momentum > 0", 0.10, "positive_momentum"),
    ("momentum", "momentum < -0.5", -0.15, "weak_momentum"),
    ("residual", "residual > 0.05", 0.10, "positive_residual_mom"),
    ("factor", "factor > 0.5", 0.15, "high_factor_composite"),
    ("factor", "factor > 0", 0.05, None),
    ("aggregate", "aggregate >= 0.75", 0.25, "aggregate_top"),
    ("aggregate", "aggregate >= 0.60", 0.15, "aggregate_strong"),
    ("aggregate", "aggregate <= 0.25", -0.10, "aggregate_weak"),
    ("flag", "flag = 'cheap-assets'", 0.08, "cheap_assets_flag"),
    ("flag", "flag = 'levered-assets'", -0.12, "levered_assets_flag"),
    ("liquidity", "liquidity < 0.15", -0.10, "low_liquidity"),
    ("fragile", "fragile", -0.30, "fragile_veto"),
    ("skew", "skew >= 0.35", -0.15, "skew_steepening"),
    ("member", "member", 0.05, "sp500_member"),
    ("stress", "stress", -0.08, "stress_regime_haircut"),
    ("stressed momentum", "stress AND (momentum IS NULL OR momentum < 0.25)", -0.05, None),
]
#: Least score of each action.
BUY_ACTIONS = [(0.55, "BUY"), (0.35, "ACCUMULATE"), (0.15, "WATCH")]

#: Yearly excess return and confidence of each decision, and what leverage and stress leave of both.
VIEWS = [("decision = 'INCLUDE_CORE' OR dual", 0.04, 0.6), ("decision = 'INCLUDE_VALUE'", 0.02, 0.4), ("decision = 'INCLUDE_QUALITY'", 0.025, 0.45), ("decision = 'AVOID'", -0.02, 0.3)]
VIEW_LEVERED, VIEW_STRESSED = (0.5, 0.7), (0.4, 0.5)

#: Weight and the two ends of each part of the membership strength.
STRENGTH = {"roe": (0.20, 0.10, 0.25), "roic": (0.20, 0.08, 0.20), "ev": (0.15, 12.0, 4.0), "pb": (0.10, 2.5, 1.0), "mca": (0.10, 1.0, 0.3), "de": (0.15, 2.5, 0.3), "ic": (0.10, 1.0, 6.0)}
STRONG_DE, STRONG_IC = 1.0, 3.0

#: Forecast change, in percent, from which a label is given, and the persistence shares that gate it.
LABEL_PERCENT, BULL_BASE, BEAR_BASE = 3.0, 0.60, 0.40
DEFAULT_TAX = 0.25


def _first(rows: list[tuple[str, object]], other: object = None) -> Column:
    """The value of the first condition that holds."""
    out = F.when(F.lit(False), F.lit(rows[0][1]))
    for condition, value in rows:
        out = out.when(F.expr(condition), F.lit(value))
    return out.otherwise(F.lit(other))


def sides(df: DataFrame) -> DataFrame:
    """df with its failed legs (see ``screens.with_legs``) and quality, value, dual: which sides of the screen pass."""
    out = screens.with_legs(df)
    return out.withColumns({"quality": F.expr("pass_roe AND pass_roic AND pass_de"), "value": F.expr("pass_ev AND pass_pb AND pass_mca")}).withColumn("dual", F.col("n_failed") == 0)


def inclusion(df: DataFrame) -> DataFrame:
    """Df with n_failed, failed_legs, near (one or two failed legs), candidacy and decision. df has the ratios of the legs and ``stab``."""
    out = sides(df).withColumn("unstable", F.coalesce(F.col("stab") < STABLE_FOR_CORE, F.lit(False)))
    ladder = lambda k: _first([(r[0], r[k]) for r in INCLUSION])
    return out.withColumns({"near": F.col("n_failed").between(1, 2), "candidacy": ladder(1), "decision": ladder(2)})


def buy_score(df: DataFrame) -> DataFrame:
    """Df with score, reasons (comma-joined) and action.

    df has decision, momentum, residual, factor, aggregate, flag, liquidity, fragile, skew, member and stress; a missing
    value adds nothing, except that under stress missing momentum counts as weak.
    """
    names = list(dict.fromkeys(t[0] for t in BUY_TERMS))
    points = sum((_first([(c, float(p)) for n, c, p, _ in BUY_TERMS if n == name], 0.0) for name in names), F.lit(0.0))
    words = [_first([(c, w) for n, c, _, w in BUY_TERMS if n == name]) for name in names if any(t[3] for t in BUY_TERMS if t[0] == name)]
    out = df.withColumn("score", F.round(points, 9)).withColumn("reasons", F.concat_ws(",", *words))
    return out.withColumn("action", _first([(f"score >= {x}", a) for x, a in BUY_ACTIONS], "AVOID"))


def views(df: DataFrame) -> DataFrame:
    """(columns of df, view, confidence): df has decision, dual, flag and stress; rows with neither view nor confidence are left out."""
    scale = lambda k: F.when(F.expr("flag = 'levered-assets'"), VIEW_LEVERED[k]).otherwise(1.0) * F.when(F.col("stress"), VIEW_STRESSED[k]).otherwise(1.0)
    out = df.withColumns({n: F.round(_first([(r[0], r[k + 1]) for r in VIEWS], 0.0) * scale(k), d) for k, (n, d) in enumerate((("view", 4), ("confidence", 3)))})
    return out.where("view <> 0 OR confidence <> 0")


def view_weights(df: DataFrame) -> DataFrame:
    """Each row's share of the positive views times their confidence; null where no view is positive."""
    raw = F.greatest("view", F.lit(0.0)) * F.col("confidence")
    total = df.agg(F.sum(raw).alias("_total"))
    return df.join(F.broadcast(total)).withColumn("weight", div(raw, F.col("_total"))).drop("_total")  # one row


def strength() -> Column:
    """Weighted mean, over the ratios that are given, of how far each lies between its two ends; 0 without any.

    A part whose ends are given from high to low scores 0, whatever its ratio, and still counts in the weight: that is
    how the reference's results come about, and it is kept.
    """
    part = lambda c, lo, hi: F.least(F.greatest((F.col(c) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)) if hi > lo else F.lit(0.0)
    total = sum((F.when(F.col(c).isNotNull(), w * part(c, lo, hi)).otherwise(0.0) for c, (w, lo, hi) in STRENGTH.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, (w, _, _) in STRENGTH.items()), F.lit(0.0))
    return F.round(F.coalesce(div(total, weight), F.lit(0.0)), 4)


def membership(df: DataFrame, size: Column, least_size: float, sector: Column) -> DataFrame:
    """Df with strength, tier by the sides that pass and the leverage, and eligible: large enough, profitable and in a sector."""
    out = sides(df).withColumn("strong", F.coalesce((F.col("de") <= STRONG_DE) & (F.col("ic") >= STRONG_IC), F.lit(False)))
    tier = _first([("quality AND value AND strong", "dual_strong"), ("quality AND value", "dual_weak"), ("quality", "quality_only"), ("value", "value_only")], "neither")
    eligible = F.coalesce((size >= least_size) & (F.col("roe") > 0), F.lit(False)) & sector.isNotNull()
    return out.withColumns({"strength": strength(), "tier": tier, "eligible": eligible})


def forecast_label(percent: Column, baseline: Column) -> tuple[Column, Column]:
    """BULL, BEAR or NEUTRAL by the forecast change in percent, and the same with a star where the entity's persistence baseline (share of rises) doesn't speak against it."""
    label = F.when(percent > LABEL_PERCENT, "BULL").when(percent < -LABEL_PERCENT, "BEAR").otherwise("NEUTRAL")
    return label, F.when((label == "BULL") & (baseline >= BULL_BASE), "BULL*").when((label == "BEAR") & (baseline <= BEAR_BASE), "BEAR*").otherwise(label)


def ratios(df: DataFrame) -> DataFrame:
    """Df with market_cap, roe, roic, de, ev_ebitda, pb, mca and coverage.

    df has price (as of the statement's date), shares, equity, assets, debt, cash, invested, ttm_ni, ttm_oi, ttm_da,
    ttm_int and tax_rate. A zero counts as missing in every input. Without invested capital, debt (none: 0) plus equity
    stands in; without a tax rate 25 %; without operating income, net income plus interest after tax is the profit.
    """
    names = ("price", "shares", "equity", "assets", "debt", "cash", "invested", "ttm_ni", "ttm_oi", "ttm_da", "ttm_int")
    v = {c: F.nullif(F.col(c), F.lit(0.0)) for c in names}
    rate = F.coalesce("tax_rate", F.lit(DEFAULT_TAX))
    cap = v["price"] * v["shares"]
    profit = F.coalesce(v["ttm_oi"] * (1 - rate), F.col("ttm_ni") + v["ttm_int"] * (1 - rate))
    invested = F.coalesce(v["invested"], F.coalesce("debt", F.lit(0.0)) + F.col("equity"))
    ebitda = F.coalesce(F.col("ttm_oi") + F.col("ttm_da"), "ttm_oi")
    value = F.nullif(cap + F.col("debt") - F.col("cash"), F.lit(0.0))
    return df.withColumns({
        "market_cap": cap, "roe": v["ttm_ni"] / v["equity"], "roic": F.nullif(profit, F.lit(0.0)) / F.nullif(invested, F.lit(0.0)), "de": v["debt"] / v["equity"],
        "ev_ebitda": value / F.nullif(ebitda, F.lit(0.0)), "pb": cap / v["equity"], "mca": cap / v["assets"], "coverage": v["ttm_oi"] / v["ttm_int"],
    })
