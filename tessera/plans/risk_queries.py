"""Performance, tails, peers, factors, regimes, sizing and backtests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import bins, div, pct_rank, ratio, safe_corr, zscore
from tessera.operators import asof, blocks, overlays, pairs, peers, quantiles, regimes, returns, risk, screens, windows
from tessera.plans.common import bars, fund, latest, market, named_regime, panels_once, query, r6, regime, rets, sect
from tessera.operators.ranks import with_pct_ranks, with_rank, with_zscores
from tessera.registry import table
from tessera.scratch import cut


def _members(spark, d):
    """Baskets: each region's suppliers."""
    return sect(spark, d).select("entity", F.col("region").alias("basket"))


@query("""WITH t AS (SELECT l_partkey AS entity, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS q, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice END AS cost, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS bought, CAST(l_shipdate AS DATE) AS dt FROM lineitem),
 g AS (SELECT entity, sum(q) AS shares, min(dt) AS first_fill, max(dt) AS last_fill, count(*) AS n_trades, sum(cost) / nullif(sum(bought), 0) AS avg_cost FROM t GROUP BY 1 HAVING sum(q) > 0), v AS (SELECT g.*, shares * p_retailprice AS value, shares * (p_retailprice - avg_cost) AS pl FROM g JOIN part ON p_partkey = entity)
 SELECT entity, shares, first_fill, last_fill, n_trades, round(avg_cost, 4) AS avg_cost, round(value, 2) AS value, round(pl, 2) AS pl, round(value / sum(value) OVER (), 8) AS weight FROM v""")
def a02_holdings(spark, d):
    li = table(spark, d, "lineitem")
    sell = F.col("l_returnflag") == "R"
    g = li.groupBy(F.col("l_partkey").alias("entity")).agg(F.sum(F.when(sell, -F.col("l_quantity")).otherwise(F.col("l_quantity"))).alias("shares"), F.min(F.col("l_shipdate").cast("date")).alias("first_fill"), F.max(F.col("l_shipdate").cast("date")).alias("last_fill"), F.count(F.lit(1)).alias("n_trades"), div(F.sum(F.when(~sell, F.col("l_extendedprice"))), F.sum(F.when(~sell, F.col("l_quantity")))).alias("avg_cost")).where("shares > 0")
    v = g.join(table(spark, d, "part").select(F.col("p_partkey").alias("entity"), "p_retailprice"), "entity").withColumns({"value": F.col("shares") * F.col("p_retailprice"), "pl": F.col("shares") * (F.col("p_retailprice") - F.col("avg_cost"))})
    total = v.agg(F.sum("value").alias("total"))
    return v.join(F.broadcast(total)).select("entity", "shares", "first_fill", "last_fill", "n_trades", F.round("avg_cost", 4).alias("avg_cost"), F.round("value", 2).alias("value"), F.round("pl", 2).alias("pl"), F.round(F.col("value") / F.col("total"), 8).alias("weight"))


_BASKET = """, m AS (SELECT region AS basket, entity, date, r FROM rets JOIN sect USING (entity) WHERE r IS NOT NULL), ew AS (SELECT basket, date, avg(r) AS b FROM m GROUP BY 1, 2), pa AS (SELECT *, exp(sum(ln(1 + b)) OVER (PARTITION BY basket ORDER BY date)) AS l FROM ew),
 dd AS (SELECT *, l / max(l) OVER (PARTITION BY basket ORDER BY date) - 1 AS dd FROM pa), e AS (SELECT basket, entity, stddev_samp(r) AS v, covar_samp(r, b) / var_samp(b) AS beta FROM m JOIN ew USING (basket, date) GROUP BY 1, 2)"""


@query(_BASKET + " SELECT basket, vol, max_dd, member_vol, beta, n FROM (SELECT basket, round(stddev_samp(b) * sqrt(252), 6) AS vol, round(min(dd), 6) AS max_dd FROM dd GROUP BY 1) JOIN (SELECT basket, round(avg(v) * sqrt(252), 6) AS member_vol, round(avg(beta), 6) AS beta, count(*) AS n FROM e GROUP BY 1) USING (basket)", "rets", "sect")
def a08_basket_risk(spark, d):
    return risk.basket_risk(rets(spark, d), _members(spark, d), "entity", "basket", "date", "r").select("basket", *r6("vol", "max_dd", "member_vol", "beta"), "n")


@query("SELECT entity, round(avg(r) * 252, 6) AS ann_ret, round(stddev_samp(r) * sqrt(252), 6) AS ann_vol, round((avg(r) * 252 - 0.04) / (stddev_samp(r) * sqrt(252)), 6) AS sharpe FROM rets GROUP BY 1", "rets")
def a10_annualised(spark, d):
    return risk.ann_stats(rets(spark, d), ["entity"], "r").select("entity", *r6("ann_ret", "ann_vol", "sharpe"))


@query(_BASKET + """, k AS (SELECT *, row_number() OVER (PARTITION BY basket ORDER BY date) AS k FROM dd), q AS (SELECT basket, max_by(l, date) / min_by(l, date) AS x, count(*) AS n, min(dd) AS max_dd, stddev_samp(b) FILTER (k > 1) * sqrt(12) AS vol, avg(b) FILTER (k > 1) * 12 AS ret FROM k GROUP BY 1)
 SELECT basket, round(x - 1, 6) AS total, round(pow(x, 12.0 / (n - 1)) - 1, 6) AS cagr, round(vol, 6) AS vol, round(ret / vol, 6) AS sharpe, round(max_dd, 6) AS max_dd, rank() OVER (ORDER BY round(x, 9) DESC) AS rank FROM q""", "rets", "sect")
def a11_level_performance(spark, d):
    ew = returns.group_returns(rets(spark, d), _members(spark, d), "entity", "basket", "date", "r")
    p = risk.level_stats(returns.levels(ew, "basket", "date", "r"), ["basket"], "date", "level")
    return p.withColumn("rank", F.rank().over(Window.orderBy(F.desc(F.round(F.col("total") + 1, 9)))).cast("long")).select("basket", *r6("total", "cagr", "vol", "sharpe", "max_dd"), "rank")  # one row per basket


@query(_BASKET + """, s AS (SELECT basket, avg(b) * 12 AS ret, stddev_samp(b) * sqrt(12) AS vol, min(dd) AS max_dd FROM dd GROUP BY 1), mk AS (SELECT avg(m) * 12 AS bench FROM market) SELECT basket, round(ret, 6) AS ret, round(vol, 6) AS vol, round(ret - bench, 6) AS excess, round(max_dd, 6) AS max_dd, round(ret / abs(max_dd), 5) AS calmar, rank() OVER (ORDER BY round(ret / vol, 9) DESC) AS rank FROM s, mk""", "market", "sect")
def a12_index_backtest(spark, d):
    ew = returns.group_returns(rets(spark, d), _members(spark, d), "entity", "basket", "date", "r")
    dd = windows.drawdown(returns.levels(ew, "basket", "date", "r"), "basket", "date", "level").groupBy("basket").agg(F.min("dd").alias("max_dd"))
    s = risk.ann_stats(ew, ["basket"], "r", 0.0, 12).join(dd, "basket").join(F.broadcast(market(spark, d).agg((F.avg("m") * 12).alias("bench"))))
    return s.select("basket", F.round("ann_ret", 6).alias("ret"), F.round("ann_vol", 6).alias("vol"), F.round(F.col("ann_ret") - F.col("bench"), 6).alias("excess"), *r6("max_dd"), F.round(ratio(F.col("ann_ret"), F.abs("max_dd")), 5).alias("calmar"), F.rank().over(Window.orderBy(F.desc(F.round("sharpe", 9)))).cast("long").alias("rank"))


@query(""", c AS (SELECT entity, date, r, exp(sum(r) OVER (PARTITION BY entity ORDER BY date)) AS cum FROM rets WHERE r IS NOT NULL), x AS (SELECT *, cum / max(cum) OVER (PARTITION BY entity ORDER BY date) - 1 AS dd FROM c), t AS (SELECT l_suppkey AS entity, l_extendedprice * (l_discount - l_tax) AS pnl FROM lineitem), h AS (SELECT entity, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS hit_rate, sum(pnl) FILTER (pnl > 0) / abs(nullif(sum(pnl) FILTER (pnl < 0), 0)) AS profit_factor FROM t GROUP BY 1)
 SELECT entity, round(avg(r) * 252 / (stddev_samp(r) * sqrt(252)), 6) AS sharpe, round(avg(r) * 252 / (stddev_samp(r) FILTER (r < 0) * sqrt(252)), 6) AS sortino, round(min(dd), 6) AS max_dd, round(CASE WHEN min(dd) < 0 THEN avg(r) * 252 / abs(min(dd)) END, 5) AS calmar,
 round(max(hit_rate), 6) AS hit_rate, round(max(profit_factor), 6) AS profit_factor, round(avg(abs(r)) * 252, 6) AS turnover, count(*) AS n FROM x LEFT JOIN h USING (entity) GROUP BY 1 HAVING count(*) >= 5""", "rets")
def a13_performance_metrics(spark, d):
    """Returns of each supplier; its lines are the trades, what they give less the tax their profit."""
    trades = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("pnl"))
    return risk.full_metrics(rets(spark, d), ["entity"], "date", "r", trades, "pnl").select("entity", *r6("sharpe", "sortino", "max_dd"), F.round("calmar", 5).alias("calmar"), *r6("hit_rate", "profit_factor", "turnover"), "n")


@query("SELECT entity, round(avg(price * qty), 2) AS adv, round(avg(price * qty) * 0.05 / 0.2, 2) AS capacity FROM bars GROUP BY 1", "bars")
def a14_capacity(spark, d):
    g = bars(spark, d).groupBy("entity").agg(F.avg(F.col("price") * F.col("qty")).alias("adv"))
    return g.select("entity", F.round("adv", 2).alias("adv"), F.round(F.col("adv") * 0.05 / 0.2, 2).alias("capacity"))


@query(", q AS (SELECT entity, quantile_cont(r, 0.05) AS v FROM rets WHERE r IS NOT NULL GROUP BY 1) SELECT entity, round(min(v), 6) AS var, round(avg(r) FILTER (r <= v), 6) AS es, round(avg(r), 6) AS mean, round(min(r), 6) AS worst FROM rets JOIN q USING (entity) GROUP BY 1", "rets")
def a15_value_at_risk(spark, d):
    return risk.tail_loss(rets(spark, d), ["entity"], "r").select("entity", *r6("var", "es", "mean", "worst"))


_G = ", g AS (SELECT date, avg(r) FILTER (region IN (0, 1)) AS core, avg(r) FILTER (region IN (2, 3, 4)) AS safe, avg(r) AS mkt FROM rets JOIN sect USING (entity) WHERE r IS NOT NULL GROUP BY 1), gv AS (SELECT *, stddev_samp(mkt) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS v FROM g)"


def _sleeves(spark, d):
    x = rets(spark, d).where("r IS NOT NULL").join(sect(spark, d), "entity")
    g = x.groupBy("date").agg(F.avg(F.when(F.col("region") < 2, F.col("r"))).alias("core"), F.avg(F.when(F.col("region") >= 2, F.col("r"))).alias("safe"), F.avg("r").alias("mkt"))
    return g.withColumn("v", F.stddev_samp("mkt").over(Window.orderBy("date").rowsBetween(-6, -1)))  # one row per date


_LEGS = "coalesce(roe >= 0.15, false) AND coalesce(roic >= 0.15, false) AND coalesce(de <= 1.0, false)"
_VALUE = "coalesce(ev <= 9.0, false) AND coalesce(pb <= 1.5, false) AND coalesce(mca <= 0.5, false)"


def _held(least: int, share: int) -> str:
    """Log returns with each supplier's sleeves; ratios are those of the customer of its number."""
    return f""", lx AS (SELECT rets.entity, date, lr, region, row_number() OVER (PARTITION BY rets.entity ORDER BY date DESC) AS rn FROM rets JOIN sect USING (entity) WHERE lr IS NOT NULL), lv AS (SELECT entity, stddev_samp(lr) AS v FROM lx WHERE rn <= 24 GROUP BY 1 HAVING count(*) > 1), lo AS (SELECT entity FROM lv QUALIFY row_number() OVER (ORDER BY v, entity) <= greatest({least}, count(*) OVER () // {share})),
 fd AS (SELECT entity, {_LEGS} AS q, {_VALUE} AS v FROM latest), sl AS (SELECT date, coalesce(avg(lr) FILTER (region < 2), 0) AS base, coalesce(avg(lr) FILTER (lo.entity IS NOT NULL), 0) AS low, coalesce(avg(lr) FILTER (region = 4), 0) AS etf, coalesce(avg(lr) FILTER (q AND v), 0) AS dual, coalesce(avg(lr) FILTER (q), 0) AS quality, coalesce(avg(lr) FILTER (v), 0) AS val, avg(lr) AS mkt FROM lx LEFT JOIN lo ON lo.entity = lx.entity LEFT JOIN fd ON fd.entity = lx.entity GROUP BY 1)"""


def _sleeve_returns(spark, d, least, share):
    x = rets(spark, d).where("lr IS NOT NULL").join(sect(spark, d).select("entity", "region"), "entity")
    low = overlays.calmest(x, "entity", "date", "lr", 24, least, share).withColumn("calm", F.lit(True))
    f = latest(spark, d).select("entity", F.expr(_LEGS).alias("q"), F.expr(_VALUE).alias("v"))
    x = x.join(low, "entity", "left").join(f, "entity", "left")
    of = lambda c: F.coalesce(F.avg(F.when(F.expr(c), F.col("lr"))), F.lit(0.0))
    return x.groupBy("date").agg(*[of(c).alias(n) for n, c in (("base", "region < 2"), ("low", "calm"), ("etf", "region = 4"), ("dual", "q AND v"), ("quality", "q"), ("value", "v"))], F.avg("lr").alias("mkt"))


_MIX = {"defensive_ew": "base", "cash_10": "0.9::DOUBLE * base", "cash_20": "0.8::DOUBLE * base", "low_vol_tilt": "0.7::DOUBLE * base + 0.3::DOUBLE * low", "dividend_etf_30": "0.7::DOUBLE * base + 0.3::DOUBLE * etf", "put_proxy": "base - CASE WHEN mkt < -0.015 THEN 0.4::DOUBLE * mkt ELSE 0 END", "dual_quality": "0.5::DOUBLE * dual + 0.5::DOUBLE * quality", "tail_combo": "0.2::DOUBLE * low + 0.2::DOUBLE * etf + 0.5::DOUBLE * base"}
_PICK = f"CASE now WHEN 'high' THEN {_MIX['tail_combo']} WHEN 'low' THEN base WHEN 'uncertain' THEN {_MIX['cash_10']} ELSE 0.85::DOUBLE * base + 0.15::DOUBLE * ({_MIX['low_vol_tilt']}) END"
_STAT = """SELECT strategy, count(*) AS n, avg(r) * 12 AS ret, stddev_samp(r) * sqrt(12) AS vol, min(dd) AS max_dd, max(q) AS var, avg(r) FILTER (r <= q) AS shortfall FROM (SELECT *, l / max(l) OVER (PARTITION BY strategy ORDER BY date) - 1 AS dd, quantile_cont(r, 0.05) OVER (PARTITION BY strategy) AS q FROM (SELECT *, exp(sum(r) OVER (PARTITION BY strategy ORDER BY date)) AS l FROM {0})) GROUP BY 1 HAVING count(*) >= 10"""


@query(_held(8, 4) + ", nw AS (SELECT max_by(regime, date) AS now FROM regime), st AS (" + " UNION ALL ".join(f"SELECT date, '{k}' AS strategy, {e} AS r FROM sl, nw" for k, e in {**_MIX, "regime_recommended": _PICK}.items()) + """), cv AS (SELECT date, CASE WHEN count(*) OVER w >= 6 THEN stddev_samp(mkt) OVER w END AS v FROM sl WINDOW w AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)), cd AS (SELECT date FROM cv WHERE v >= (SELECT quantile_cont(v, 0.8) FROM cv)), sc AS (SELECT st.* FROM st JOIN cd USING (date)),
 a AS (""" + _STAT.format("st") + "), c AS (" + _STAT.format("sc") + """) SELECT a.strategy, round(a.ret, 6) AS ret, round(a.vol, 6) AS vol, CASE WHEN a.vol > 0 THEN round(a.ret / a.vol, 6) END AS sharpe, round(a.max_dd, 6) AS max_dd, round(a.var, 6) AS var, round(a.shortfall, 6) AS shortfall, round(c.ret, 6) AS crisis_ret, round(c.vol, 6) AS crisis_vol, round(c.shortfall, 6) AS crisis_shortfall FROM a LEFT JOIN c USING (strategy)""", "regime", "sect", "latest")
def a16_overlay_strategies(spark, d):
    """Eight overlays and the one that the present regime recommends, over all dates and over those of high volatility."""
    x = cut(_sleeve_returns(spark, d, 8, 4), "sleeves")
    now = named_regime(spark, d).agg(F.max_by("regime", "date").alias("now"))
    s = overlays.strategies(x.join(F.broadcast(now)), "date", F.col("now"))  # one row
    crisis = s.join(overlays.crisis_dates(x, "date", 6).where("crisis").select("date"), "date")
    every = overlays.log_return_stats(s, ["strategy"], "date", "r", 12)
    hard = overlays.log_return_stats(crisis, ["strategy"], "date", "r", 12).select("strategy", *[F.col(c).alias(f"crisis_{c}") for c in ("ret", "vol", "shortfall")])
    return every.join(hard, "strategy", "left").select("strategy", *r6("ret", "vol", "sharpe", "max_dd", "var", "shortfall", "crisis_ret", "crisis_vol", "crisis_shortfall"))


_WEIGHT = lambda k: "CASE tb " + " ".join(f"WHEN '{t}' THEN {row[k]}::DOUBLE" for t, row in overlays.WEIGHTS.items()) + " END"
_ROTATE = _held(5, 3) + """, rg AS (SELECT sl.*, lag(CASE regime WHEN 'high' THEN 'high_vol_stress' WHEN 'low' THEN 'low_vol' ELSE regime END) OVER (ORDER BY date) AS regime FROM sl JOIN regime USING (date)), vo AS (SELECT * REPLACE (coalesce(regime, 'normal') AS regime), CASE WHEN count(*) OVER w >= 6 THEN stddev_samp(mkt) OVER w END AS v FROM rg WINDOW w AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
 kn AS (SELECT *, lag(v IGNORE NULLS) OVER (ORDER BY date) AS now, count(v) OVER b AS seen, quantile_cont(v, 0.8) OVER s AS high, count(*) OVER e >= 6 AND sum(val) OVER e < sum(quality) OVER e AS cheap FROM vo WINDOW b AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s AS (ORDER BY date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), e AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
 fl AS (SELECT *, (now >= high OR regime = 'high_vol_stress') AND regime <> 'uncertain' AS off, regime = 'low_vol' AS onn FROM kn),
 tt AS (SELECT *, CASE WHEN seen < 8 THEN 'start' WHEN off THEN 'risk_off' WHEN onn AND NOT cheap THEN 'risk_on' WHEN cheap THEN 'value_cheap' ELSE 'neutral' END AS tb, CASE WHEN seen >= 8 AND off THEN 'risk_off' WHEN seen >= 8 AND onn THEN 'risk_on' ELSE 'neutral' END AS state FROM fl),
 ro AS (SELECT date, state, regime, """ + ", ".join(f"{_WEIGHT(k)} AS w_{n}" for k, n in enumerate(overlays.SLEEVES)) + ", " + " + ".join(f"{_WEIGHT(k)} * {c}" for k, c in enumerate(("quality", "val", "low", "etf", "dual", "base"))) + " AS ret, base AS static FROM tt)"


def _rotation(spark, d):
    """Each month's weights by the volatility and the regime of the month before."""
    x = _sleeve_returns(spark, d, 5, 3).select("date", "mkt", "quality", "value", "dual", F.col("low").alias("low_vol"), F.col("etf").alias("dividend"), F.col("base").alias("defensive"))
    x = x.join(named_regime(spark, d).select("date", "regime"), "date").withColumn("regime", F.coalesce(F.lag("regime").over(Window.orderBy("date")), F.lit("normal")))  # one row per date
    return overlays.rotation(x, "date", "regime", 6, 24, 8, 6)


@query(_ROTATE + " SELECT date, state, regime, " + ", ".join(f"w_{n}" for n in overlays.SLEEVES) + ", round(ret, 6) AS ret, round(static, 6) AS static FROM ro", "regime", "sect", "latest")
def a17_sleeve_rotation(spark, d):
    return _rotation(spark, d).select("date", "state", "regime", *[f"w_{n}" for n in overlays.SLEEVES], *r6("ret", "static"))


@query(_ROTATE + " SELECT state, count(*) AS months, round(avg(ret) * 12, 6) AS ret, round(avg(static) * 12, 6) AS static, round(stddev_samp(ret) * sqrt(12), 6) AS vol, round(stddev_samp(static) * sqrt(12), 6) AS static_vol FROM ro GROUP BY 1", "regime", "sect", "latest")
def a17_sleeve_statistics(spark, d):
    """The rotation and the standing defensive sleeve in the months of each state."""
    g = _rotation(spark, d).groupBy("state")
    return g.agg(F.count(F.lit(1)).alias("months"), *[F.round(F.avg(c) * 12, 6).alias(c) for c in ("ret", "static")], F.round(F.stddev_samp("ret") * 12**0.5, 6).alias("vol"), F.round(F.stddev_samp("static") * 12**0.5, 6).alias("static_vol"))


@query(_G + " SELECT round(avg(core) * 12, 6) AS ret, round((avg(core) - avg(mkt)) * 12, 6) AS excess, round(avg(core - mkt) / stddev_samp(core - mkt) * sqrt(12), 6) AS info_ratio, round(avg(CASE WHEN core > mkt THEN 1.0 ELSE 0 END), 6) AS win_rate, round(avg(CASE WHEN sign(core) = sign(mkt) THEN 1.0 ELSE 0 END), 6) AS agree FROM g", "rets", "sect")
def a18_baseline_comparison(spark, d):
    x = F.col("core") - F.col("mkt")
    return _sleeves(spark, d).agg(F.round(F.avg("core") * 12, 6).alias("ret"), F.round((F.avg("core") - F.avg("mkt")) * 12, 6).alias("excess"), F.round(F.avg(x) / F.stddev_samp(x) * 12**0.5, 6).alias("info_ratio"), F.round(F.avg((x > 0).cast("double")), 6).alias("win_rate"), F.round(F.avg((F.signum("core") == F.signum("mkt")).cast("double")), 6).alias("agree"))


@query(""", t AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM bars WHERE qty > 0), g AS (SELECT entity, avg(price * qty) AS dv, avg(qty) AS shares FROM t WHERE rn <= 21 GROUP BY 1)
 SELECT entity, round(dv, 2) AS dv, round(shares, 4) AS shares, round((rank() OVER (ORDER BY dv) + (count(*) OVER (PARTITION BY dv) - 1) / 2.0) / count(*) OVER (), 6) AS pctile, dv <= (SELECT quantile_cont(dv, 0.2) FROM g) AS illiquid FROM g""", "bars")
def a19_liquidity(spark, d):
    g = returns.last_rows(bars(spark, d).where("qty > 0"), "entity", "date", 21).groupBy("entity").agg(F.avg(F.col("price") * F.col("qty")).alias("dv"), F.avg("qty").alias("shares"))
    g = cut(g, "liquidity")
    q = quantiles.quantiles(g, [], "dv", {"q": 0.2})
    out = with_pct_ranks(g, {"pctile": "dv"})
    return out.join(F.broadcast(q)).select("entity", F.round("dv", 2).alias("dv"), F.round("shares", 4).alias("shares"), *r6("pctile"), (F.col("dv") <= F.col("q")).alias("illiquid"))


@query(""", w AS (SELECT sector, entity, sum(price * qty) AS v, avg(price * qty) AS adv FROM bars JOIN sect USING (entity) GROUP BY 1, 2), be AS (SELECT entity, covar_samp(r, m) / var_samp(m) AS beta FROM rets JOIN market USING (date) WHERE r IS NOT NULL GROUP BY 1), x AS (SELECT sector, entity, adv, beta, v / sum(v) OVER (PARTITION BY sector) AS w FROM w LEFT JOIN be USING (entity)), y AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY w DESC, entity) AS rn FROM x)
 SELECT sector, round(sum(w * w), 6) AS hhi, round(max(w), 6) AS top1, round(sum(w) FILTER (rn <= 3), 6) AS top3, round(1 / sum(w * w), 6) AS effective, round(sum(w * adv), 2) AS liquidity, round(sum(w * beta), 6) AS beta FROM y GROUP BY 1""", "market", "sect")
def a20_concentration(spark, d):
    w = bars(spark, d).join(sect(spark, d), "entity").groupBy("sector", "entity").agg(F.sum(F.col("price") * F.col("qty")).alias("v"), F.avg(F.col("price") * F.col("qty")).alias("adv"))
    beta = rets(spark, d).where("r IS NOT NULL").join(market(spark, d), "date").groupBy("entity").agg(div(F.covar_samp("r", "m"), F.var_samp("m")).alias("beta"))
    out = risk.concentration(w.join(beta, "entity", "left"), ["sector"], "v", "entity", ["adv", "beta"])
    return out.select("sector", *r6("hhi", "top1", "top3", "effective"), F.round("adv", 2).alias("liquidity"), *r6("beta"))


@query(""", x AS (SELECT entity, date, r, m, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM rets JOIN market USING (date) WHERE r IS NOT NULL), dd AS (SELECT entity, min(price / pk - 1) AS max_dd FROM (SELECT *, max(price) OVER (PARTITION BY entity ORDER BY date) AS pk FROM bars) GROUP BY 1)
 SELECT entity, round(stddev_samp(r) FILTER (rn <= 24) * sqrt(252), 6) AS vol, round(covar_samp(r, m) FILTER (rn <= 48) / var_samp(m) FILTER (rn <= 48), 6) AS beta, round(min(max_dd), 6) AS max_dd FROM x JOIN dd USING (entity) GROUP BY 1""", "market")
def a21_entity_risk(spark, d):
    x = rets(spark, d).where("r IS NOT NULL").join(market(spark, d), "date").withColumn("rn", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("date"))))
    on = lambda n, c: F.when(F.col("rn") <= n, F.col(c))
    g = x.groupBy("entity").agg((F.stddev_samp(on(24, "r")) * 252**0.5).alias("vol"), div(F.covar_samp(on(48, "r"), on(48, "m")), F.var_samp(on(48, "m"))).alias("beta"))
    dd = windows.drawdown(bars(spark, d), "entity", "date", "price").groupBy("entity").agg(F.min("dd").alias("max_dd"))
    return g.join(dd, "entity").select("entity", *r6("vol", "beta", "max_dd"))


_MOM = """, b AS (SELECT entity, date, price, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM bars), px AS (SELECT entity, max(price) FILTER (rn = 1) AS z, max(price) FILTER (rn = 2) AS p1, max(price) FILTER (rn = 4) AS p3, max(price) FILTER (rn = 7) AS p6, max(price) FILTER (rn = 13) AS p12 FROM b GROUP BY 1),
 k AS (SELECT entity, date, r, m, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM rets JOIN market USING (date) WHERE r IS NOT NULL), be AS (SELECT entity, covar_samp(r, m) / var_samp(m) AS beta FROM k GROUP BY 1 HAVING count(*) > 12), re AS (SELECT entity, avg(r - beta * m) FILTER (rn <= 3) * 3 AS resid3 FROM k JOIN be USING (entity) GROUP BY 1),
 g AS (SELECT entity, z / p1 - 1 AS m1, z / p3 - 1 AS m3, z / p6 - 1 AS m6, z / p12 - 1 AS m12, p1 / p12 - 1 AS m12_1, resid3 FROM px LEFT JOIN re USING (entity)),
 s AS (SELECT *, round((""" + " + ".join(f"coalesce(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 0)" for c in ("m1", "m3", "m6", "m12_1", "resid3")) + ") / nullif(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in ("m1", "m3", "m6", "m12_1", "resid3")) + """, 0), 6) AS score FROM g),
 q AS (SELECT *, CAST(1 + floor((row_number() OVER (ORDER BY score, entity) - 1) * 5 / count(*) OVER ()) AS INTEGER) AS bucket FROM s)"""


def _momentum(spark, d):
    """Returns over 1, 3, 6 and 12 rows, 12 less the newest, residual of the market over 3, the mean z-score of those that an entity has and its fifths of equal number."""
    b = bars(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("date"))))
    at = lambda n: F.max(F.when(F.col("rn") == n + 1, F.col("price")))
    g = b.where("rn <= 13").groupBy("entity").agg(*[(div(at(0), at(k)) - 1).alias(f"m{k}") for k in (1, 3, 6, 12)], (div(at(1), at(12)) - 1).alias("m12_1"))
    resid = peers.residual_momentum(rets(spark, d).join(market(spark, d), "date"), "entity", "date", "r", "m", 3, 12).withColumnRenamed("resid", "resid3")
    parts = ["m1", "m3", "m6", "m12_1", "resid3"]
    x = with_zscores(cut(g.join(resid, "entity", "left"), "momentum"), {f"z_{c}": c for c in parts})
    x = cut(x.withColumn("score", F.round(div(sum((F.col(f"z_{c}") for c in parts), F.lit(0.0)), sum((F.col(c).isNotNull().cast("int") for c in parts), F.lit(0))), 6)).drop(*[f"z_{c}" for c in parts]), "scores")
    return peers.even_buckets(x, ["score", "entity"], 5)


@query(_MOM + " SELECT entity, round(m1, 6) AS m1, round(m3, 6) AS m3, round(m6, 6) AS m6, round(m12, 6) AS m12, round(m12_1, 6) AS m12_1, round(resid3, 6) AS resid3, score, bucket FROM q", "market")
def a22_momentum(spark, d):
    return _momentum(spark, d).select("entity", *r6("m1", "m3", "m6", "m12", "m12_1", "resid3"), "score", "bucket")


@query(_MOM + " SELECT bucket, count(*) AS n, round(avg(score), 5) AS score, round(avg(m1), 5) AS m1, round(avg(m12_1), 5) AS m12_1 FROM q GROUP BY 1", "market")
def a22_momentum_buckets(spark, d):
    return _momentum(spark, d).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 5).alias(c) for c in ("score", "m1", "m12_1")])


_QB = "(SELECT as_of, quantile_cont(roe, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM fund GROUP BY 1)"


@query(f", e AS {_QB} SELECT entity, as_of, CAST(greatest(1, len(list_filter(list_distinct(q), lambda x : x < roe))) AS INTEGER) AS bucket FROM fund JOIN e USING (as_of)", "fund")
def w09_quintiles(spark, d):
    return peers.quintile(fund(spark, d), "as_of", "roe").select("entity", "as_of", "bucket")


_RANKED = """, s AS (SELECT entity, date, r AS sig, lead(price, 1) OVER (PARTITION BY entity ORDER BY date) / price - 1 AS fwd FROM rets), k AS (SELECT date, sig, fwd, rank() OVER (PARTITION BY date ORDER BY sig) + (count(*) OVER (PARTITION BY date, sig) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS rf FROM s WHERE sig IS NOT NULL AND fwd IS NOT NULL),
 ic AS (SELECT date, corr(rs, rf) AS spearman, corr(sig, fwd) AS pearson, count(*) AS n FROM k GROUP BY 1)"""


def _ic(spark, d):
    s = returns.forward(rets(spark, d), "entity", "date", "price", 1)
    return peers.rank_ic(s, ["date"], "r", "fwd")


@query(_RANKED + " SELECT date, round(spearman, 6) AS spearman, round(pearson, 6) AS pearson, n FROM ic", "rets")
def a23_rank_ic(spark, d):
    return _ic(spark, d).select("date", *r6("spearman", "pearson"), "n")


_FAMILIES = """, sg AS (SELECT entity, date, -r AS reversal, price / lag(price, 6) OVER w - 1 AS momentum, CASE WHEN count(r) OVER t >= 6 THEN -stddev_samp(r) OVER t END AS stable, lead(price, 1) OVER w / price - 1 AS fwd FROM rets WINDOW w AS (PARTITION BY entity ORDER BY date), t AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
 u AS (SELECT family, date, s, fwd FROM sg UNPIVOT (s FOR family IN (reversal, momentum, stable)) WHERE fwd IS NOT NULL), rk AS (SELECT family, date, rank() OVER (PARTITION BY family, date ORDER BY s) + (count(*) OVER (PARTITION BY family, date, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY family, date ORDER BY fwd) + (count(*) OVER (PARTITION BY family, date, fwd) - 1) / 2.0 AS b FROM u),
 fi AS (SELECT family, date, corr(a, b) AS ic FROM rk GROUP BY 1, 2), ff AS (SELECT family, avg(ic) AS ic, count(ic) AS n, greatest(avg(ic), 0) * sqrt(count(ic) / 504.0::DOUBLE) AS up FROM fi GROUP BY 1)"""


_SIGNALS = ["reversal", "momentum", "stable"]


def _signals(spark, d):
    """Three signals of each entity and date, and the next return."""
    w = Window.partitionBy("entity").orderBy("date")
    tail = w.rowsBetween(-5, 0)
    return rets(spark, d).select("entity", "date", (-F.col("r")).alias("reversal"), (div(F.col("price"), F.lag("price", 6).over(w)) - 1).alias("momentum"), F.when(F.count("r").over(tail) >= 6, -F.stddev_samp("r").over(tail)).alias("stable"), (div(F.lead("price").over(w), F.col("price")) - 1).alias("fwd"))


def _weights(spark, d):
    return peers.family_weights(_signals(spark, d).unpivot(["date", "fwd"], _SIGNALS, "family", "s"), "family", "date", "s", "fwd", aged=True)


@query(_FAMILIES + " SELECT family, round(ic, 6) AS ic, n, round(up / nullif(sum(up) OVER (), 0), 6) AS weight FROM ff", "rets")
def a34_family_weights(spark, d):
    """Mean rank correlation of three signals with the next return, as weights that aren't negative and grow with the length of the history."""
    f = _weights(spark, d)
    return f.select("family", *r6("ic"), "n", *r6("weight"))


@query(_RANKED + ", g AS (SELECT regime, avg(spearman) AS ic, count(*) AS n FROM ic JOIN regime USING (date) GROUP BY 1), now AS (SELECT max_by(regime, date) AS regime FROM regime) SELECT g.regime, round(ic, 6) AS ic, n, g.regime = now.regime AS active, round(greatest(ic, 0) / nullif(sum(greatest(ic, 0)) OVER (), 0), 6) AS weight FROM g, now", "regime")
def a35_ic_by_regime(spark, d):
    g = _ic(spark, d).join(regime(spark, d), "date").groupBy("regime").agg(F.avg("spearman").alias("ic"), F.count(F.lit(1)).alias("n"))
    now = regime(spark, d).agg(F.max_by("regime", "date").alias("_now"))
    up = F.greatest("ic", F.lit(0.0))
    return g.join(F.broadcast(now)).select("regime", *r6("ic"), "n", (F.col("regime") == F.col("_now")).alias("active"), F.round(div(up, F.sum(up).over(Window.partitionBy())), 6).alias("weight"))  # one row per regime


_ZF = lambda c: f"CASE WHEN {c} IS NULL OR NOT coalesce(stddev_samp({c}) OVER p > 0, false) THEN 0 ELSE ({c} - avg({c}) OVER p) / stddev_samp({c}) OVER p END"


@query(f", z AS (SELECT entity, as_of, {_ZF('1 / nullif(ev, 0)')} AS zv, {_ZF('roe')} AS zq, {_ZF('-de')} AS zd FROM fund WINDOW p AS (PARTITION BY as_of)) SELECT entity, as_of, round(zv, 6) AS zv, round(zq, 6) AS zq, round(0.4 * zv + 0.4 * zq + 0.2 * zd, 6) AS composite FROM z", "fund")
def a24_factor_panel(spark, d):
    p = Window.partitionBy("as_of")
    x = fund(spark, d).withColumns({"zv": zscore(div(F.lit(1.0), F.col("ev")), p), "zq": zscore(F.col("roe"), p), "zd": zscore(-F.col("de"), p)})
    return x.withColumn("composite", 0.4 * F.col("zv") + 0.4 * F.col("zq") + 0.2 * F.col("zd")).select("entity", "as_of", *r6("zv", "zq", "composite"))


@query(f", z AS (SELECT entity, as_of, {_ZF('roe')} AS z FROM fund WINDOW p AS (PARTITION BY as_of)) SELECT entity, as_of, round(z, 6) AS z FROM z", "fund")
def w11_cross_section_z(spark, d):
    return fund(spark, d).select("entity", "as_of", F.round(zscore(F.col("roe"), Window.partitionBy("as_of")), 6).alias("z"))


_LS = """, s AS (SELECT rets.entity, date, sector, r AS sig, lead(price, 1) OVER (PARTITION BY rets.entity ORDER BY date) / price - 1 AS fwd FROM rets JOIN sect USING (entity)), n AS (SELECT *, (rank() OVER (PARTITION BY date, sector ORDER BY sig) + (count(*) OVER (PARTITION BY date, sector, sig) - 1) / 2.0) / count(*) OVER (PARTITION BY date, sector) AS p FROM s WHERE sig IS NOT NULL),
 ls AS (SELECT date, avg(fwd) FILTER (p > 0.8) AS up, avg(fwd) FILTER (p <= 0.2) AS down FROM n GROUP BY 1), gs AS (SELECT date, sector, count(*) AS a, count(*) FILTER (p > 0.8) AS c FROM n GROUP BY 1, 2),
 ex AS (SELECT date, avg(off) AS exposure_dev FROM (SELECT date, c, abs(c / nullif(sum(c) OVER (PARTITION BY date), 0) - a / sum(a) OVER (PARTITION BY date)) AS off FROM gs) WHERE c > 0 GROUP BY 1)"""


def _sector_ranks(spark, d):
    s = returns.forward(rets(spark, d).join(sect(spark, d), "entity"), "entity", "date", "price", 1).where("r IS NOT NULL")
    return s.withColumn("p", pct_rank(F.col("r"), Window.partitionBy("date", "sector")))


@query(_LS + " SELECT ls.date, round(up, 6) AS long, round(-down, 6) AS short, round(up - down, 6) AS gross, round(up - down - 2 * 10.0 / 10000, 6) AS net, round(exposure_dev, 6) AS exposure_dev FROM ls LEFT JOIN ex ON ls.date = ex.date", "rets", "sect")
def a25_long_short_backtest(spark, d):
    n = _sector_ranks(spark, d)
    g = n.groupBy("date").agg(F.avg(F.when(F.col("p") > 0.8, F.col("fwd"))).alias("long"), F.avg(F.when(F.col("p") <= 0.2, F.col("fwd"))).alias("down"))
    g = g.join(peers.exposure_deviation(n, "date", "sector", F.col("p") > 0.8), "date", "left").withColumn("gross", F.col("long") - F.col("down"))
    return g.select("date", *r6("long"), F.round(-F.col("down"), 6).alias("short"), *r6("gross"), F.round(F.col("gross") - 2 * 10.0 / 10000, 6).alias("net"), *r6("exposure_dev"))


@query(_LS + " SELECT CAST(ceil(round(p * 5, 9)) AS INTEGER) AS bucket, count(*) AS n, round(avg(fwd), 6) AS fwd FROM n GROUP BY 1", "rets", "sect")
def a25_bucket_returns(spark, d):
    return _sector_ranks(spark, d).groupBy(F.ceil(F.round(F.col("p") * 5, 9)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fwd"), 6).alias("fwd"))


@query(", l AS (SELECT c_mktsegment AS segment, roe, pb FROM latest JOIN customer ON c_custkey = entity), u AS (SELECT segment, metric, v FROM l UNPIVOT (v FOR metric IN (roe, pb))) SELECT segment, metric, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75 FROM u GROUP BY 1, 2", "latest")
def a26_group_summary(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment"))
    return peers.group_summary(latest(spark, d).join(c, "entity"), "segment", ["roe", "pb"]).select("segment", "metric", "n", *r6("mean", "median", "std", "p25", "p75"))


_PEER = lambda c, o: f"round((rank() OVER (PARTITION BY rows, sector ORDER BY {c}{o}) - 1) / nullif(count(*) OVER (PARTITION BY rows, sector) - 1, 0), 6)"


@query(f""", k AS (SELECT sector, entity, r, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM rets JOIN sect USING (entity) WHERE r IS NOT NULL), v AS (SELECT rows, sector, entity, avg(r) AS m, stddev_samp(r) AS s FROM k JOIN (VALUES (12), (36), (84)) t(rows) ON rn <= rows GROUP BY 1, 2, 3 HAVING stddev_samp(r) > 0)
 SELECT rows, sector, entity, {_PEER("m", "")} AS ret_rank, {_PEER("s", " DESC")} AS vol_rank, {_PEER("round(m / s, 12)", "")} AS ratio_rank FROM v""", "rets", "sect")
def a27_peer_ranks(spark, d):
    """Ranks among a sector's other members over the last 12, 36 and 84 rows."""
    k = rets(spark, d).where("r IS NOT NULL").join(sect(spark, d), "entity").withColumn("rn", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("date")))).where("rn <= 84")
    spans = F.filter(F.array(*[F.lit(n) for n in (12, 36, 84)]), lambda n: F.col("rn") <= n)
    v = k.withColumn("rows", F.explode(spans)).groupBy("rows", "sector", "entity").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s")).where("s > 0").withColumn("ms", F.round(F.col("m") / F.col("s"), 12))
    for x, name, low in (("m", "ret_rank", False), ("s", "vol_rank", True), ("ms", "ratio_rank", False)):
        v = peers.leave_one_out_rank(v, ["rows", "sector"], x, name, low)
    return v.select("rows", "sector", "entity", *r6("ret_rank", "vol_rank", "ratio_rank"))


@query(""", x AS (SELECT rets.entity, sector, date, r, avg(r) OVER (PARTITION BY sector, date) AS g FROM rets JOIN sect USING (entity) WHERE r IS NOT NULL), b AS (SELECT *, CASE WHEN count(*) OVER w >= 12 THEN coalesce(covar_samp(r, g) OVER w / nullif(var_pop(g) OVER w, 0), 1) END AS beta FROM x WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
 l AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM b WHERE beta IS NOT NULL), m AS (SELECT sector, entity, avg(beta) AS mean_beta FROM l WHERE rn <= 20 GROUP BY 1, 2), q AS (SELECT sector, median(mean_beta) AS md, quantile_cont(mean_beta, 0.25) AS a, quantile_cont(mean_beta, 0.75) AS z FROM m GROUP BY 1)
 SELECT sector, entity, round(mean_beta, 6) AS mean_beta, round(md, 6) AS median_beta, mean_beta > z AS high, mean_beta < a AS low FROM m JOIN q USING (sector)""", "rets", "sect")
def a28_group_betas(spark, d):
    x = rets(spark, d).where("r IS NOT NULL").join(sect(spark, d), "entity").withColumn("g", F.avg("r").over(Window.partitionBy("sector", "date")))
    rolled = windows.rolling_pair(x, "entity", "date", "r", "g", 12)
    # The covariance is the sample's, the variance the population's; a group without variance counts as 1.
    rolled = rolled.withColumn("beta", F.when(F.col("cov").isNotNull(), F.coalesce(F.col("beta") * 12 / 11, F.lit(1.0))))
    return peers.average_rolling_beta(rolled, "entity", "sector", "beta", "date", 20).select("sector", "entity", *r6("mean_beta", "median_beta"), "high", "low")


_METRICS = ["roe", "roic", "de", "ev", "pb", "mca", "stab", "ic"]
_TREND = """, h AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY as_of) AS DOUBLE) AS i, count(*) OVER (PARTITION BY entity) AS m FROM fund), u AS (SELECT entity, i, metric, v FROM (SELECT * FROM h WHERE m >= 4) UNPIVOT (v FOR metric IN (roe, roic, de, ev, pb, mca, stab, ic))), n AS (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY i) AS k, count(*) OVER (PARTITION BY entity, metric) AS n FROM u WHERE v IS NOT NULL),
 t0 AS (SELECT entity, metric, round(covar_samp(i, v) / var_pop(i), 12) AS slope, max(i) - min(i) AS span, min_by(v, i) AS f, avg(v) FILTER (k > n - 2) AS recent, avg(v) FILTER (k <= 2) AS early FROM n WHERE n >= 4 GROUP BY 1, 2), t AS (SELECT *, slope * span AS change, slope * span / nullif(f, 0) AS relative, (recent - early) / nullif(early, 0) AS shift FROM t0),
 fl AS (SELECT *, coalesce(slope < 0 AND shift > 0.05::DOUBLE, false) AS recovering, coalesce(slope > 0 AND shift < -0.05::DOUBLE, false) AS deteriorating, coalesce(abs(slope) > 0.01::DOUBLE AND sign(slope) = sign(shift), false) AS strong FROM t)"""


def _trends(spark, d):
    return peers.trend_flags(peers.trends(fund(spark, d), "entity", "as_of", _METRICS))


@query(_TREND + " SELECT entity, metric, round(slope, 6) AS slope, round(change, 6) AS change, round(relative, 6) AS relative, round(shift, 6) AS shift FROM t", "fund")
def a29_fundamental_trends(spark, d):
    return _trends(spark, d).select("entity", "metric", *r6("slope", "change", "relative", "shift"))


@query(_TREND + " SELECT entity, metric, recovering, deteriorating, strong FROM fl", "fund")
def a30_trend_flags(spark, d):
    return _trends(spark, d).select("entity", "metric", "recovering", "deteriorating", "strong")


#: Each supplier's groups: its nation and its region.
_GROUPS = """, gm AS (SELECT entity, 'nation ' || sector AS grp FROM sect UNION ALL SELECT entity, 'region ' || region FROM sect),
 k AS (SELECT grp, entity, r, row_number() OVER (PARTITION BY grp, entity ORDER BY date DESC) AS rn FROM rets JOIN gm USING (entity) WHERE r IS NOT NULL), pv AS (SELECT grp, entity, avg(r) AS m, stddev_samp(r) AS s FROM k WHERE rn <= 36 GROUP BY 1, 2 HAVING stddev_samp(r) > 0),
 pr AS (SELECT grp, entity, """ + ", ".join(f"(rank() OVER (PARTITION BY grp ORDER BY {c}{o}) - 1) / nullif(count(*) OVER (PARTITION BY grp) - 1, 0)::DOUBLE AS {n}" for c, o, n in (("m", "", "ret_rank"), ("s", " DESC", "vol_rank"), ("round(m / s, 12)", "", "ratio_rank"))) + """ FROM pv),
 pb AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ratio_rank DESC NULLS LAST, grp) = 1),
 gx AS (SELECT grp, entity, date, r, avg(r) OVER (PARTITION BY grp, date) AS g FROM rets JOIN gm USING (entity) WHERE r IS NOT NULL), gb AS (SELECT *, CASE WHEN count(*) OVER w >= 12 THEN coalesce(covar_samp(r, g) OVER w / nullif(var_pop(g) OVER w, 0), 1) END AS beta FROM gx WINDOW w AS (PARTITION BY grp, entity ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
 gl AS (SELECT *, row_number() OVER (PARTITION BY grp, entity ORDER BY date DESC) AS rn FROM gb WHERE beta IS NOT NULL), gmn AS (SELECT grp, entity, avg(beta) AS beta FROM gl WHERE rn <= 20 GROUP BY 1, 2), gq AS (SELECT grp, median(beta) AS md, quantile_cont(beta, 0.25) AS a, quantile_cont(beta, 0.75) AS z FROM gmn GROUP BY 1),
 bt AS (SELECT entity, avg(beta) AS mean_beta, avg(beta - md) AS mean_off_median, bool_or(beta > z) AS high_any, bool_or(beta < a) AS low_any FROM gmn JOIN gq USING (grp) GROUP BY 1)"""


def _peer_ranks(x, rows):
    """Ranks of each entity among the others of each of its groups over its last rows."""
    v = x.withColumn("rn", F.row_number().over(Window.partitionBy("group", "entity").orderBy(F.desc("date")))).where(F.col("rn") <= rows).groupBy("group", "entity").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s")).where("s > 0").withColumn("ms", F.round(F.col("m") / F.col("s"), 12))
    for c, name, low in (("m", "ret_rank", False), ("s", "vol_rank", True), ("ms", "ratio_rank", False)):
        v = peers.leave_one_out_rank(v, "group", c, name, low)
    return v.select("entity", "group", "ret_rank", "vol_rank", "ratio_rank")


@query(_TREND + _GROUPS + """, f AS (SELECT entity, CAST(count(*) FILTER (recovering) AS INTEGER) AS recovering, CAST(count(*) FILTER (deteriorating) AS INTEGER) AS deteriorating, CAST(count(*) FILTER (strong) AS INTEGER) AS strong FROM fl GROUP BY 1)
 SELECT sect.entity, coalesce(recovering, 0) AS recovering, coalesce(deteriorating, 0) AS deteriorating, coalesce(strong, 0) AS strong, pb.grp AS best_group, round(ratio_rank, 6) AS best_ratio_rank, round(mean_beta, 6) AS mean_beta, round(mean_off_median, 6) AS mean_off_median,
 CASE WHEN recovering >= 2 THEN 'RECOVERING' WHEN deteriorating >= 2 THEN 'DETERIORATING' WHEN strong >= 3 THEN 'STRONG_TREND' ELSE 'NEUTRAL' END AS fundamental_signal, CASE WHEN ratio_rank >= 0.75 THEN 'PEER_LEADER' WHEN ratio_rank <= 0.25 THEN 'PEER_LAGGARD' ELSE 'PEER_AVERAGE' END AS peer_signal, CASE WHEN high_any THEN 'HIGH_BETA' WHEN low_any THEN 'LOW_BETA' ELSE 'NEUTRAL_BETA' END AS beta_signal
 FROM sect LEFT JOIN f USING (entity) LEFT JOIN pb ON pb.entity = sect.entity LEFT JOIN bt ON bt.entity = sect.entity""", "fund", "rets", "sect")
def a31_signal_assembly(spark, d):
    """Trends of the customer of the supplier's number, peers and betas in the supplier's nation and region."""
    s = sect(spark, d)
    groups = s.select("entity", F.concat(F.lit("nation "), F.col("sector").cast("string")).alias("group")).unionByName(s.select("entity", F.concat(F.lit("region "), F.col("region").cast("string")).alias("group")))
    x = rets(spark, d).where("r IS NOT NULL").join(groups, "entity")
    rolled = windows.rolling_pair(x.withColumn("g", F.avg("r").over(Window.partitionBy("group", "date"))), ["group", "entity"], "date", "r", "g", 12)
    beta = F.when(F.col("cov").isNotNull(), F.coalesce(F.col("beta") * 12 / 11, F.lit(1.0)))
    betas = peers.average_rolling_beta(rolled.withColumn("beta", beta), "entity", "group", "beta", "date", 20).select("entity", F.col("mean_beta").alias("beta"), (F.col("mean_beta") - F.col("median_beta")).alias("off_median"), "high", "low")
    out = peers.assembled_signals(s.select("entity"), "entity", _trends(spark, d), _peer_ranks(x, 36), betas)
    return out.select("entity", "recovering", "deteriorating", "strong", "best_group", *r6("best_ratio_rank", "mean_beta", "mean_off_median"), "fundamental_signal", "peer_signal", "beta_signal")


_DRIFT = """, ev AS (SELECT entity, as_of, amount / lag(amount) OVER (PARTITION BY entity ORDER BY as_of) - 1 AS surprise, lead(amount, 1) OVER (PARTITION BY entity ORDER BY as_of) / amount - 1 AS d1, lead(amount, 3) OVER (PARTITION BY entity ORDER BY as_of) / amount - 1 AS d3 FROM fund),
 bk AS (SELECT *, CASE WHEN 100 * surprise >= 5 THEN 'big_beat' WHEN surprise >= 0 THEN 'beat' ELSE 'miss' END AS bucket FROM ev WHERE surprise IS NOT NULL)"""


def _events(spark, d):
    w = Window.partitionBy("entity").orderBy("as_of")
    x = fund(spark, d).select("entity", "as_of", (div(F.col("amount"), F.lag("amount").over(w)) - 1).alias("surprise"), *[(div(F.lead("amount", h).over(w), F.col("amount")) - 1).alias(f"d{h}") for h in (1, 3)])
    return x.where("surprise IS NOT NULL").withColumn("bucket", peers.surprise_bucket(100 * F.col("surprise")))


@query(_DRIFT + " SELECT bucket, count(*) AS n, round(avg(d1), 6) AS d1, round(avg(d3), 6) AS d3 FROM bk GROUP BY 1", "fund")
def a32_event_drift(spark, d):
    return _events(spark, d).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d1"), 6).alias("d1"), F.round(F.avg("d3"), 6).alias("d3"))


@query(_DRIFT + """, e AS (SELECT bucket, avg(d3) AS exp FROM bk GROUP BY 1), l AS (SELECT * FROM bk QUALIFY row_number() OVER (PARTITION BY entity ORDER BY as_of DESC) = 1),
 pm AS (WITH x AS (SELECT entity, date, price / lag(price, 6) OVER (PARTITION BY entity ORDER BY date) - 1 AS r, count(*) OVER (PARTITION BY entity) AS n FROM bars), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM x WHERE r IS NOT NULL AND n >= 30), y AS (SELECT *, max(CASE WHEN rn = 1 THEN r END) OVER (PARTITION BY entity) AS now FROM k WHERE rn <= 24) SELECT entity, round(avg(CASE WHEN r < now THEN 1.0::DOUBLE ELSE 0 END), 3) AS mom FROM y GROUP BY 1),
 j AS (SELECT c_custkey AS entity, exp, mom FROM customer LEFT JOIN l ON l.entity = c_custkey LEFT JOIN e USING (bucket) LEFT JOIN pm ON pm.entity = c_custkey),
 r AS (SELECT *, CASE WHEN exp IS NULL THEN 0.5 ELSE (rank() OVER (ORDER BY exp NULLS LAST) + (count(*) OVER (PARTITION BY exp) - 1) / 2.0::DOUBLE) / count(exp) OVER () END AS pe, CASE WHEN mom IS NULL THEN 0.5 ELSE (rank() OVER (ORDER BY mom NULLS LAST) + (count(*) OVER (PARTITION BY mom) - 1) / 2.0::DOUBLE) / count(mom) OVER () END AS pm FROM j)
 SELECT entity, round((0.7::DOUBLE * pe + 0.3::DOUBLE * pm) * CASE WHEN exp IS NULL THEN 0 ELSE 1 END, 6) AS score, CASE WHEN mom >= 0.67 THEN 'hot' WHEN mom <= 0.33 THEN 'cold' WHEN mom IS NOT NULL THEN 'neutral' END AS momentum_flag FROM r""", "fund", "bars")
def a33_event_catalyst(spark, d):
    """All customers: the drift that their last surprise's bucket lets expect, and the momentum before it of the supplier of their number."""
    x = _events(spark, d)
    e = x.groupBy("bucket").agg(F.avg("d3").alias("expected"))
    last = returns.latest(x, "entity", "as_of").join(F.broadcast(e), "bucket").select("entity", "expected")  # one row per bucket
    momentum = windows.recent_percentile(bars(spark, d), "entity", "date", "price", 6, 24, 30).select("entity", F.round("pctile", 3).alias("momentum"))
    every = table(spark, d, "customer").select(F.col("c_custkey").alias("entity")).join(last, "entity", "left").join(momentum, "entity", "left")
    return peers.catalyst(every, "expected", "momentum").select("entity", *r6("score"), "momentum_flag")


_COMPOSITE = _FAMILIES + ", wf AS (SELECT family, coalesce(up / nullif(sum(up) OVER (), 0), 0) AS weight FROM ff), ls AS (SELECT * FROM sg QUALIFY row_number() OVER (PARTITION BY entity ORDER BY date DESC) = 1), lp AS (SELECT entity, " + ", ".join(f"(CASE WHEN {c} IS NULL THEN 0.5 ELSE (rank() OVER (ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE) / count({c}) OVER () END) * coalesce((SELECT weight FROM wf WHERE family = '{c}'), 0) AS {c}" for c in _SIGNALS) + " FROM ls), cp AS (SELECT entity, round((" + " + ".join(_SIGNALS) + ") / (SELECT nullif(sum(weight), 0) FROM wf), 4) AS composite FROM lp)"


def composite(spark, d):
    """Each entity's newest signals, weighted by how well they told the next return."""
    now = returns.latest(_signals(spark, d).select("entity", "date", *_SIGNALS), "entity", "date")
    return peers.family_composite(now, "entity", _SIGNALS, _weights(spark, d))


@query(_COMPOSITE + " SELECT entity, composite, rank() OVER (ORDER BY composite DESC NULLS LAST) AS rank FROM cp", "rets")
def a36_ranked_composite(spark, d):
    return composite(spark, d).select("entity", "composite", "rank")


_MASKS = """, v AS (SELECT *, CASE WHEN count(*) OVER w >= 6 THEN stddev_samp(m) OVER w END AS vol, exp(sum(ln(1 + m)) OVER (ORDER BY date)) AS l FROM market WINDOW w AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)), x AS (SELECT *, l / max(l) OVER (ORDER BY date) - 1 AS dd FROM v), q AS (SELECT quantile_cont(vol, 0.8) AS qv, quantile_cont(m, 0.05) AS qr, quantile_cont(dd, 0.1) AS qd FROM x), mask AS (SELECT date, m, vol, dd, coalesce(vol >= qv, false) AS high_vol, m <= qr AS worst, dd <= qd AS deep FROM x, q)"""


@query(_MASKS + " SELECT date, round(vol, 6) AS vol, round(dd, 6) AS dd, high_vol, worst, deep FROM mask", "market")
def a39_crisis_masks(spark, d):
    return regimes.crisis_masks(market(spark, d), "date", "m").select("date", *r6("vol", "dd"), "high_vol", "worst", "deep")


@query(_MASKS + """, k AS (SELECT date, 'all' AS mask FROM mask UNION ALL SELECT date, 'calm' FROM mask WHERE NOT high_vol AND NOT worst AND NOT deep UNION ALL SELECT date, 'high_vol' FROM mask WHERE high_vol UNION ALL SELECT date, 'worst' FROM mask WHERE worst UNION ALL SELECT date, 'deep' FROM mask WHERE deep),
 z AS (SELECT sector, entity, date, r FROM rets JOIN sect USING (entity) WHERE r IS NOT NULL), c AS (SELECT mask, a.entity AS a, b.entity AS b, corr(a.r, b.r) AS c FROM z a JOIN z b ON a.sector = b.sector AND a.date = b.date AND a.entity < b.entity JOIN k ON k.date = a.date GROUP BY 1, 2, 3 HAVING count(*) >= 4)
 SELECT mask, (SELECT count(*) FROM k k2 WHERE k2.mask = c.mask) AS days, count(c) AS pairs, round(avg(c), 6) AS mean_corr, round(median(c), 6) AS median_corr FROM c GROUP BY 1""", "market", "sect")
def a39_crisis_correlation(spark, d):
    """Average and median correlation of the pairs inside sectors on the dates of each mask."""
    m = cut(regimes.crisis_masks(market(spark, d), "date", "m"), "masks")
    calm = ~F.col("high_vol") & ~F.col("worst") & ~F.col("deep")
    names = F.array_compact(F.array(F.lit("all"), F.when(calm, "calm"), *[F.when(F.col(c), c) for c in ("high_vol", "worst", "deep")]))
    k = m.select("date", F.explode(names).alias("mask"))
    c = blocks.corr_quantiles(rets(spark, d).join(sect(spark, d), "entity"), "entity", "date", "r", ["sector"], 4, k, {"median_corr": 0.5})
    days = k.groupBy("mask").agg(F.count(F.lit(1)).alias("days"))
    return c.join(days, "mask").select("mask", "days", "pairs", F.round("mean", 6).alias("mean_corr"), *r6("median_corr"))


@query(", v AS (SELECT sector, entity, stddev_samp(r) * sqrt(252) AS vol FROM rets JOIN sect USING (entity) GROUP BY 1, 2), w AS (SELECT *, 1 / vol / sum(1 / vol) OVER (PARTITION BY sector) AS iv, least(greatest(0.15 / vol, 0.02), 0.25) AS raw FROM v) SELECT sector, entity, round(iv, 6) AS inv_vol, round(raw / sum(raw) OVER (PARTITION BY sector), 6) AS target FROM w", "rets", "sect")
def a49_inverse_volatility(spark, d):
    v = rets(spark, d).join(sect(spark, d), "entity").groupBy("sector", "entity").agg((F.stddev_samp("r") * 252**0.5).alias("vol"))
    p = Window.partitionBy("sector")
    v = v.withColumns({"i": div(F.lit(1.0), F.col("vol")), "raw": F.least(F.greatest(0.15 / F.col("vol"), F.lit(0.02)), F.lit(0.25))})
    return v.withColumns({"inv_vol": F.col("i") / F.sum("i").over(p), "target": F.col("raw") / F.sum("raw").over(p)}).select("sector", "entity", *r6("inv_vol", "target"))


@query(", v AS (SELECT sector, entity, stddev_samp(r) AS vol FROM rets JOIN sect USING (entity) GROUP BY 1, 2), w AS (SELECT *, 1 / vol / sum(1 / vol) OVER p AS t, 1.0::DOUBLE / count(*) OVER p AS c FROM v WINDOW p AS (PARTITION BY sector)), k AS (SELECT *, least(greatest(t, greatest(c - 0.1::DOUBLE * c, 0)), c + 0.1::DOUBLE * c) AS k FROM w) SELECT sector, entity, round(c, 6) AS now, round(k / sum(k) OVER (PARTITION BY sector), 6) AS capped FROM k", "rets", "sect")
def a50_turnover_cap(spark, d):
    v = rets(spark, d).join(sect(spark, d), "entity").groupBy("sector", "entity").agg(F.stddev_samp("r").alias("vol"))
    p = Window.partitionBy("sector")
    v = v.withColumn("i", div(F.lit(1.0), F.col("vol"))).withColumns({"t": F.col("i") / F.sum("i").over(p), "now": F.lit(1.0) / F.count(F.lit(1)).over(p)})
    return risk.turnover_cap(v, ["sector"], "t", "now", 0.1, "capped").select("sector", "entity", *r6("now", "capped"))


@query(""", v AS (SELECT entity, date, CASE WHEN count(r) OVER w >= 12 THEN stddev_samp(r) OVER w * sqrt(252) END AS vol FROM rets WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)), g AS (SELECT entity, max_by(vol, date) AS now, median(vol) AS med, quantile_cont(vol, 0.75) AS p75 FROM v WHERE vol IS NOT NULL GROUP BY 1), h AS (SELECT entity, max_by(price, date) AS price, max_by(qty, date) AS held, sum(max_by(price * qty, date)) OVER () AS total FROM bars GROUP BY 1)
 SELECT entity, round(least(greatest(0.3 / p75, 0.01), 0.12) * total / price - held, 4) AS share_delta, round(least(greatest(0.3 / p75, 0.01), 0.12) * total - held * price, 2) AS value_delta, round(now, 6) AS now, round(med, 6) AS med, round(p75, 6) AS p75, round(least(greatest(0.3 / p75, 0.01), 0.12), 6) AS weight, 0.3 / p75 > 0.12 AS capped FROM g JOIN h USING (entity)""", "rets")
def a52_volatility_sizing(spark, d):
    v = windows.rolling_vol(rets(spark, d), "entity", "date", "r", 12).where("vol IS NOT NULL")
    g = v.groupBy("entity").agg(F.max_by("vol", "date").alias("now"), F.median("vol").alias("med"), F.percentile("vol", F.lit(0.75)).alias("p75"))
    raw = div(F.lit(0.3), F.col("p75"))
    h = bars(spark, d).groupBy("entity").agg(F.max_by("price", "date").alias("price"), F.max_by("qty", "date").alias("held"))
    total = h.agg(F.sum(F.col("price") * F.col("held")).alias("total"))
    g = g.join(h, "entity").join(F.broadcast(total)).withColumn("goal", F.least(F.greatest(raw, F.lit(0.01)), F.lit(0.12)) * F.col("total"))
    deltas = [F.round(F.col("goal") / F.col("price") - F.col("held"), 4).alias("share_delta"), F.round(F.col("goal") - F.col("held") * F.col("price"), 2).alias("value_delta")]
    return g.select("entity", *deltas, *r6("now", "med", "p75"), F.round(F.least(F.greatest(raw, F.lit(0.01)), F.lit(0.12)), 6).alias("weight"), (raw > 0.12).alias("capped"))


@query(", v AS (SELECT sector, entity, stddev_samp(r) AS vol, max_by(price * qty, date) AS mv FROM rets JOIN sect USING (entity) GROUP BY 1, 2) SELECT sector, entity, round(mv / sum(mv) OVER p, 6) AS current, round(1 / vol / sum(1 / vol) OVER p, 6) AS inv_vol, round(mv / sum(mv) OVER p - 1 / vol / sum(1 / vol) OVER p, 6) AS delta FROM v WINDOW p AS (PARTITION BY sector)", "rets", "sect")
def a53_weight_comparison(spark, d):
    v = rets(spark, d).join(sect(spark, d), "entity").groupBy("sector", "entity").agg(F.stddev_samp("r").alias("vol"), F.max_by(F.col("price") * F.col("qty"), "date").alias("mv"))
    p = Window.partitionBy("sector")
    v = v.withColumn("i", div(F.lit(1.0), F.col("vol"))).withColumns({"current": F.col("mv") / F.sum("mv").over(p), "inv_vol": F.col("i") / F.sum("i").over(p)})
    return v.withColumn("delta", F.col("current") - F.col("inv_vol")).select("sector", "entity", *r6("current", "inv_vol", "delta"))


@query(", v AS (SELECT sector, entity, stddev_samp(r) AS vol, max_by(price * qty, date) AS mv FROM rets JOIN sect USING (entity) GROUP BY 1, 2), w AS (SELECT sector, entity, mv / sum(mv) OVER p AS c, 1 / vol / sum(1 / vol) OVER p AS i, 1.0::DOUBLE / count(*) OVER p AS e FROM v WINDOW p AS (PARTITION BY sector)), s AS (SELECT sector, date, sum(c * r) AS c, sum(i * r) AS i, sum(e * r) AS e FROM w JOIN rets USING (entity) WHERE r IS NOT NULL GROUP BY 1, 2) SELECT sector, round(stddev_samp(c) * sqrt(252), 6) AS current_vol, round(stddev_samp(i) * sqrt(252), 6) AS inv_vol, round(stddev_samp(e) * sqrt(252), 6) AS equal_vol FROM s GROUP BY 1", "rets", "sect")
def a53_portfolio_volatility(spark, d):
    """Volatility of each sector's portfolio under its current, inverse-volatility and equal weights."""
    r = rets(spark, d)
    v = r.join(sect(spark, d), "entity").groupBy("sector", "entity").agg(F.stddev_samp("r").alias("vol"), F.max_by(F.col("price") * F.col("qty"), "date").alias("mv"))
    p = Window.partitionBy("sector")
    inv = div(F.lit(1.0), F.col("vol"))
    w = v.select("sector", "entity", (F.col("mv") / F.sum("mv").over(p)).alias("c"), (inv / F.sum(inv).over(p)).alias("i"), (F.lit(1.0) / F.count(F.lit(1)).over(p)).alias("e"))
    s = w.join(r.where("r IS NOT NULL").select("entity", "date", "r"), "entity").groupBy("sector", "date").agg(*[F.sum(F.col(k) * F.col("r")).alias(k) for k in "cie"])
    return s.groupBy("sector").agg(*[F.round(F.stddev_samp(k) * 252**0.5, 6).alias(n) for k, n in (("c", "current_vol"), ("i", "inv_vol"), ("e", "equal_vol"))])


@query(", g AS (SELECT entity, avg(r) AS mu, stddev_samp(r) AS sd, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS p, avg(r) FILTER (r > 0) / abs(avg(r) FILTER (r < 0)) AS b FROM rets WHERE r IS NOT NULL GROUP BY 1) SELECT entity, round((mu - 0.001) / (sd * sd), 5) AS continuous, round(p - (1 - p) / b, 6) AS binary FROM g", "rets")
def a54_kelly(spark, d):
    r = F.col("r")
    g = rets(spark, d).where("r IS NOT NULL").groupBy("entity").agg(F.avg(r).alias("mu"), F.stddev_samp(r).alias("sd"), F.avg((r > 0).cast("double")).alias("p"), div(F.avg(F.when(r > 0, r)), F.abs(F.avg(F.when(r < 0, r)))).alias("b"))
    return g.select("entity", F.round(risk.kelly(F.col("mu"), F.col("sd"), F.lit(0.001)), 5).alias("continuous"), F.round(risk.binary_kelly(F.col("p"), F.col("b")), 6).alias("binary"))


_GAPS = """, x AS (SELECT entity, date, ((high + low) / 2) / lag(price) OVER w - 1 AS g, price / lag(price) OVER w - 1 AS r FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date))"""


@query(_GAPS + """ SELECT entity, count(g) AS n, round(avg(g), 6) AS mean_gap, round(stddev_samp(g), 6) AS gap_std, round(stddev_samp(r), 6) AS ret_std, round(var_samp(g) / var_samp(r), 6) AS variance_share, round(avg(CASE WHEN abs(g) > 0.03 THEN 1.0 WHEN g IS NULL THEN NULL ELSE 0 END), 6) AS over_3, round(avg(CASE WHEN abs(g) > 0.05 THEN 1.0 WHEN g IS NULL THEN NULL ELSE 0 END), 6) AS over_5, round(max(abs(g)), 6) AS largest, round(min(g), 6) AS worst FROM x GROUP BY 1 HAVING count(g) >= 30""", "bars")
def a55_gap_profile(spark, d):
    b = bars(spark, d).withColumn("opened", (F.col("high") + F.col("low")) / 2)
    return risk.gaps(b, "entity", "date", "opened", "price", "n").where("n >= 30").select("entity", "n", *r6("mean_gap", "gap_std", "ret_std", "variance_share", "over_3", "over_5", "largest", "worst"))


@query(_GAPS + " SELECT entity, date, round(100 * g, 4) AS gap_pct, round(100 * r, 4) AS close_pct FROM x WHERE abs(g) > 0.05", "bars")
def a55_gap_events(spark, d):
    """Every gap of over 5 %, with the whole move."""
    b = bars(spark, d).withColumn("opened", (F.col("high") + F.col("low")) / 2)
    return risk.gap_events(b, "entity", "date", "opened", "price").select("entity", "date", F.round("gap_pct", 4).alias("gap_pct"), F.round("close_pct", 4).alias("close_pct"))


@query(""", x AS (SELECT entity, abs(r) AS x, row_number() OVER (PARTITION BY entity ORDER BY abs(r) DESC) AS rn, count(*) OVER (PARTITION BY entity) AS n FROM rets WHERE abs(r) > 0), t AS (SELECT *, least(greatest(5, floor(0.1 * n)), n - 1) AS k FROM x) SELECT entity, CAST(max(k) AS BIGINT) AS k, round(max(k) / (sum(ln(x)) - max(k) * ln(min(x))), 6) AS alpha FROM t WHERE rn <= k GROUP BY 1""", "rets")
def a56_hill_index(spark, d):
    return risk.hill(rets(spark, d), ["entity"], "r").select("entity", F.col("k").cast("long").alias("k"), *r6("alpha"))


@query(", s AS (SELECT entity, avg(r) AS m, stddev_pop(r) AS s FROM rets GROUP BY 1) SELECT entity, " + ", ".join(f"round(avg(CASE WHEN abs((r - m) / s) > {k} THEN 1.0 ELSE 0 END), 6) AS p{k}, round(avg(CASE WHEN abs((r - m) / s) > {k} THEN 1.0 ELSE 0 END) / {v!r}, 3) AS x{k}" for k, v in risk.NORMAL_TAIL.items()) + ", round(kurtosis(r), 6) AS kurtosis FROM rets JOIN s USING (entity) WHERE r IS NOT NULL GROUP BY 1", "rets")
def a57_tail_table(spark, d):
    return risk.tail_table(rets(spark, d).where("r IS NOT NULL"), ["entity"], "r").select("entity", *r6("p3", "p4", "p5"), *[F.round(f"x{k}", 3).alias(f"x{k}") for k in (3, 4, 5)], *r6("kurtosis"))


@query(", s AS (SELECT entity, avg(r) AS m, stddev_pop(r) AS s FROM rets GROUP BY 1), u AS (SELECT date, avg((r - m) / s) AS u FROM rets JOIN s USING (entity) WHERE r IS NOT NULL GROUP BY 1) SELECT count(*) AS n, round(stddev_pop(u), 6) AS sd, round(avg(CASE WHEN abs(u - (SELECT avg(u) FROM u)) > 3 * (SELECT stddev_pop(u) FROM u) THEN 1.0 ELSE 0 END), 6) AS p3, round(kurtosis(u), 6) AS kurtosis FROM u", "rets")
def a59_standardised_universe(spark, d):
    r = rets(spark, d).where("r IS NOT NULL")
    s = r.groupBy("entity").agg(F.avg("r").alias("mu"), F.stddev_pop("r").alias("sd"))
    u = r.join(s, "entity").groupBy("date").agg(F.avg(div(F.col("r") - F.col("mu"), F.col("sd"))).alias("u")).withColumn("all", F.lit(1))
    t = risk.tail_table(u, ["all"], "u").join(u.groupBy("all").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("u").alias("sd")), "all")
    return t.select("n", *r6("sd", "p3", "kurtosis"))


@query("SELECT entity, round(avg(r), 6) AS arithmetic, round(exp(avg(ln(1 + r))) - 1, 6) AS geometric, round(avg(r) - (exp(avg(ln(1 + r))) - 1), 6) AS drag FROM rets WHERE r IS NOT NULL GROUP BY 1 HAVING min(r) > -1", "rets")
def a60_variance_drag(spark, d):
    g = rets(spark, d).where("r IS NOT NULL").groupBy("entity").agg(F.avg("r").alias("arithmetic"), F.when(F.min("r") > -1, F.expm1(F.avg(F.log1p("r")))).alias("geometric")).where("geometric IS NOT NULL")
    return g.withColumn("drag", F.col("arithmetic") - F.col("geometric")).select("entity", *r6("arithmetic", "geometric", "drag"))


@query(""", n AS (SELECT entity, r, row_number() OVER (PARTITION BY entity ORDER BY date) AS rn, count(*) OVER (PARTITION BY entity) AS n FROM rets WHERE r IS NOT NULL), g AS (SELECT DISTINCT entity, n, path, block FROM n, range(20) p(path), range(6) b(block)),
 s AS (SELECT entity, path, block, CAST('0x' || substr(md5('11:' || entity || ':' || path || ':' || block), 1, 12) AS BIGINT) % greatest(n - 5, 1) + 1 AS start FROM g), d AS (SELECT s.entity, path, block, rn - start AS step, r FROM s JOIN n ON n.entity = s.entity AND rn BETWEEN start AND start + 5),
 l AS (SELECT entity, path, block, step, exp(sum(ln(1 + greatest(r, -0.999999))) OVER (PARTITION BY entity, path ORDER BY block, step)) AS l FROM d), m AS (SELECT entity, path, l, l / greatest(max(l) OVER (PARTITION BY entity, path ORDER BY block, step), 1) - 1 AS dd FROM l),
 w AS (SELECT entity, path, min(l) AS low, min(dd) AS dd FROM m GROUP BY 1, 2) SELECT entity, round(avg(CASE WHEN low < 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_ruin, round(avg(CASE WHEN dd < -0.2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_drop, count(*) AS paths FROM w GROUP BY 1""", "rets")
def a61_bootstrap_ruin(spark, d):
    return risk.bootstrap(spark, rets(spark, d), "entity", "date", "r", paths=20, blocks=6, block=6, seed=11).select("entity", *r6("p_ruin", "p_drop"), "paths")


_BARBELL = """, o AS (SELECT entity, ((high + low) / 2) / lag(price) OVER w - 1 AS gap, price / lag(price) OVER w - 1 AS r FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)), nv AS (SELECT entity, stddev_samp(r) * sqrt(252) AS vol, coalesce(var_samp(gap) / nullif(var_samp(r), 0), 0.5) AS gap_share FROM o GROUP BY 1 HAVING count(r) > 30),
 qq AS (SELECT quantile_cont(vol, 0.25) AS vq, quantile_cont(vol, 0.8) AS vh, quantile_cont(gap_share, 0.9) AS gh FROM nv), bb AS (SELECT entity, vol, gap_share, CASE WHEN vol <= vq AND gap_share <= gh THEN 'safe' WHEN vol >= vh OR gap_share > 1.2 THEN 'convex' ELSE 'middle' END AS bucket FROM nv, qq)"""


def _barbell(spark, d):
    g = risk.gaps(bars(spark, d).withColumn("opened", (F.col("high") + F.col("low")) / 2), "entity", "date", "opened", "price", "_n").where("_n > 30")
    return risk.barbell(g.select("entity", (F.col("ret_std") * 252**0.5).alias("vol"), F.coalesce("variance_share", F.lit(0.5)).alias("gap_share")))


@query(_BARBELL + " SELECT entity, round(vol, 5) AS vol, round(gap_share, 5) AS gap_share, bucket FROM bb", "bars")
def a62_volatility_beta(spark, d):
    """The bucket of each supplier: calm without gaps, wild or full of gaps, or between."""
    return _barbell(spark, d).select("entity", F.round("vol", 5).alias("vol"), F.round("gap_share", 5).alias("gap_share"), "bucket")


@query(_BARBELL + """, v AS (SELECT date, m, CASE WHEN count(*) OVER w >= 6 THEN stddev_samp(m) OVER w END * sqrt(252) AS v FROM market WINDOW w AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)), dv AS (SELECT m, v - lag(v) OVER (ORDER BY date) AS dv FROM v), pf AS (SELECT regr_slope(m, dv) AS vol_beta, regr_slope(m, abs(dv)) AS size_beta FROM dv WHERE dv IS NOT NULL),
 sh AS (SELECT avg(CASE WHEN bucket = 'safe' THEN 1.0::DOUBLE ELSE 0 END) AS safe, avg(CASE WHEN bucket = 'middle' THEN 1.0::DOUBLE ELSE 0 END) AS middle, avg(CASE WHEN bucket = 'convex' THEN 1.0::DOUBLE ELSE 0 END) AS convex FROM bb) SELECT round(vol_beta, 5) AS vol_beta, round(size_beta, 5) AS size_beta, round(safe, 6) AS safe, round(middle, 6) AS middle, round(convex, 6) AS convex, round(safe + convex - middle, 6) AS barbell FROM pf, sh""", "bars", "market")
def a62_bucket_shares(spark, d):
    """The shares of the buckets, and how the average return moves with changes of its volatility and with their size."""
    w = Window.orderBy("date")  # one row per date
    six = w.rowsBetween(-5, 0)
    m = market(spark, d).withColumn("v", F.when(F.count(F.lit(1)).over(six) >= 6, F.stddev_samp("m").over(six)) * 252**0.5).withColumn("dv", F.col("v") - F.lag("v").over(w)).where("dv IS NOT NULL")
    slope = lambda x: div(F.covar_samp("m", x), F.var_samp(x))
    betas = m.withColumn("size", F.abs("dv")).agg(F.round(slope("dv"), 5).alias("vol_beta"), F.round(slope("size"), 5).alias("size_beta"))
    share = lambda b: F.avg((F.col("bucket") == b).cast("double"))
    shares = _barbell(spark, d).agg(*[share(b).alias(b) for b in ("safe", "middle", "convex")]).withColumn("barbell", F.col("safe") + F.col("convex") - F.col("middle"))
    return betas.join(F.broadcast(shares)).select("vol_beta", "size_beta", *r6("safe", "middle", "convex", "barbell"))  # both are one row


_PR = lambda c: f"CASE WHEN {c} IS NULL THEN 0.5 ELSE (rank() OVER (ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count({c}) OVER () END"
#: Weights of the parts of the fragility score.
FRAGILITY = {"leverage": 0.18, "asset_coverage": 0.12, "interest_coverage": 0.12, "iv_skew": 0.12, "illiquidity": 0.12, "gap_share": 0.14, "tail_fatness": 0.14, "kurtosis": 0.06}


_FRAGILE = f""", g AS (SELECT entity, max_by(price * qty, date) AS last, kurtosis(r) AS kurtosis, -avg(price * qty) AS illiquidity, count(r) AS n FROM rets GROUP BY 1), o AS (SELECT entity, ((high + low) / 2) / lag(price) OVER w - 1 AS gap, price / lag(price) OVER w - 1 AS r FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)),
 gs AS (SELECT entity, var_samp(gap) / var_samp(r) AS gap_share FROM o GROUP BY 1), x AS (SELECT entity, abs(r) AS x, row_number() OVER (PARTITION BY entity ORDER BY abs(r) DESC) AS rn, count(*) OVER (PARTITION BY entity) AS n FROM rets WHERE abs(r) > 0), t AS (SELECT *, least(greatest(5, floor(0.1 * n)), n - 1) AS k FROM x),
 h AS (SELECT entity, -max(k) / (sum(ln(x)) - max(k) * ln(min(x))) AS tail_fatness FROM t WHERE rn <= k GROUP BY 1),
 j AS (SELECT g.entity, de AS leverage, mca AS asset_coverage, 1 / nullif(ic, 0) AS interest_coverage, stab AS iv_skew, illiquidity, gap_share, tail_fatness, kurtosis FROM g LEFT JOIN latest USING (entity) LEFT JOIN gs USING (entity) LEFT JOIN h USING (entity)),
 p AS (SELECT entity, ({" + ".join(f"{w} * {_PR(c)}" for c, w in FRAGILITY.items())}) / {sum(FRAGILITY.values())} AS s FROM j), fg AS (SELECT entity, round(s, 6) AS fragility, {_PR('round(s, 6)')} >= 0.9 AS flagged FROM p)"""


@query(_FRAGILE + " SELECT entity, fragility, flagged FROM fg", "rets", "latest")
@panels_once("bars")
def a63_fragility(spark, d):
    """Parts without a table of their own stand in: leverage, coverage and skew are those of the customer with the supplier's number; a missing part is neutral."""
    b = bars(spark, d)
    g = rets(spark, d).groupBy("entity").agg(risk.sample_kurtosis("r").alias("kurtosis"), (-F.avg(F.col("price") * F.col("qty"))).alias("illiquidity"))
    own = latest(spark, d).select("entity", F.col("de").alias("leverage"), F.col("mca").alias("asset_coverage"), div(F.lit(1.0), F.col("ic")).alias("interest_coverage"), F.col("stab").alias("iv_skew"))
    gap = risk.gaps(b.withColumn("opened", (F.col("high") + F.col("low")) / 2), "entity", "date", "opened", "price").select("entity", F.col("variance_share").alias("gap_share"))
    tail = risk.hill(rets(spark, d), ["entity"], "r").select("entity", (-F.col("alpha")).alias("tail_fatness"))
    x = cut(g.join(own, "entity", "left").join(gap, "entity", "left").join(tail, "entity", "left"), "fragility")
    x = risk.weighted_ranks(x, FRAGILITY, "s").select("entity", F.round("s", 6).alias("fragility"))
    return with_pct_ranks(cut(x, "fragility"), {"p": "fragility"}).select("entity", "fragility", (F.col("p") >= 0.9).alias("flagged"))


_FC = ", f AS (SELECT entity, date, price, lag(price) OVER w AS f1, lag(price, 3) OVER w AS f3, lag(price, 4) OVER w AS f4 FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)), h AS (SELECT entity, date, 1 AS horizon, f1 AS fc, price, f4 AS before FROM f UNION ALL SELECT entity, date, 3, f3, price, f4 FROM f)"


_ERRORS = _FC + ", e AS (SELECT entity, horizon, count(*) AS n, avg(CASE WHEN sign(price - before) = sign(fc - before) THEN 1.0::DOUBLE ELSE 0 END) FILTER (before IS NOT NULL) AS direction, avg(abs(fc - price)) AS mae, sqrt(avg((fc - price) * (fc - price))) AS rmse, 100 * avg(abs(fc - price) / price) AS mape FROM h WHERE fc IS NOT NULL GROUP BY 1, 2)"


def _errors(spark, d):
    w = Window.partitionBy("entity").orderBy("date")
    b = bars(spark, d).select("entity", "price", F.lag("price").over(w).alias("f1"), F.lag("price", 3).over(w).alias("f3"), F.lag("price", 4).over(w).alias("before")).selectExpr("entity", "price", "before", "stack(2, 1, f1, 3, f3) AS (horizon, fc)").where("fc IS NOT NULL")
    hit = F.when(F.col("before").isNotNull(), (F.signum(F.col("price") - F.col("before")) == F.signum(F.col("fc") - F.col("before"))).cast("double"))
    err = F.col("fc") - F.col("price")
    return b.groupBy("entity", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), (100 * F.avg(F.abs(err) / F.col("price"))).alias("mape"), F.avg(hit).alias("direction"))


@query(_ERRORS + " SELECT entity, horizon, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape, round(direction, 6) AS direction, CASE WHEN direction IS NULL THEN NULL WHEN round(direction, 6) <= 0.45 THEN 'weak' WHEN round(direction, 6) <= 0.55 THEN 'mixed' ELSE 'strong' END AS tier FROM e", "bars")
def a67_forecast_errors(spark, d):
    g = _errors(spark, d).withColumn("direction", F.round("direction", 6))
    return g.select("entity", "horizon", "n", *r6("mae", "rmse", "mape"), "direction", risk.reliability_tier(F.col("direction")).alias("tier"))


@query(_ERRORS + ", s AS (SELECT horizon, round(avg(direction), 6) AS mean_direction, round(avg(mae), 6) AS mean_mae, round(avg(mape), 6) AS mean_mape, count(DISTINCT entity) AS entities, CAST(sum(n) AS BIGINT) AS origins FROM e GROUP BY 1) SELECT *, row_number() OVER (ORDER BY mean_direction DESC NULLS LAST, mean_mae, horizon) AS rank FROM s", "bars")
def a67_setup_ranking(spark, d):
    """Setups, here horizons, from the best mean direction on, then by the mean error; one row per setup."""
    g = _errors(spark, d).groupBy("horizon").agg(F.round(F.avg("direction"), 6).alias("mean_direction"), F.round(F.avg("mae"), 6).alias("mean_mae"), F.round(F.avg("mape"), 6).alias("mean_mape"), F.count_distinct("entity").alias("entities"), F.sum("n").alias("origins"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("mean_direction"), "mean_mae", "horizon")).cast("long"))


@query(_FC + ", b AS (SELECT horizon, avg(abs(fc - price)) AS mae FROM h WHERE fc IS NOT NULL GROUP BY 1) SELECT horizon, round(mae, 6) AS mae FROM b", "bars")
def w42_persistence_baseline(spark, d):
    w = Window.partitionBy("entity").orderBy("date")
    x = bars(spark, d).select("price", F.lag("price").over(w).alias("f1"), F.lag("price", 3).over(w).alias("f3")).selectExpr("price", "stack(2, 1, f1, 3, f3) AS (horizon, fc)")
    return x.where("fc IS NOT NULL").groupBy("horizon").agg(F.round(F.avg(F.abs(F.col("fc") - F.col("price"))), 6).alias("mae"))


@query("SELECT entity, date, round(r - 0.05 * 10 / 10000, 8) AS net, round(r - 10.0 / 10000 - 25.0 / 10000 * 21 / 252, 8) AS net_trade FROM rets WHERE r IS NOT NULL", "rets")
def a71_trading_costs(spark, d):
    return rets(spark, d).where("r IS NOT NULL").select("entity", "date", F.round(F.col("r") - 0.05 * 10 / 10000, 8).alias("net"), F.round(F.col("r") - 10.0 / 10000 - 25.0 / 10000 * 21 / 252, 8).alias("net_trade"))


@query(_BASKET + ", c AS (SELECT x.basket, avg(corr) AS mean_corr FROM (SELECT x.basket, y.basket AS other, corr(x.b, y.b) AS corr FROM ew x JOIN ew y ON x.date = y.date AND x.basket <> y.basket GROUP BY 1, 2) x GROUP BY 1) SELECT basket, round(avg(b) * 12, 6) AS ret, round(stddev_samp(b) * sqrt(12), 6) AS vol, round(min(mean_corr), 6) AS mean_corr FROM ew JOIN c USING (basket) GROUP BY 1", "rets", "sect")
def a75_sleeve_performance(spark, d):
    ew = returns.group_returns(rets(spark, d), _members(spark, d), "entity", "basket", "date", "r")
    c = pairs.pair_stats(pairs.paired(ew, "basket", "date", "r", []), []).select("a", "b", "corr")
    both = c.select(F.col("a").alias("basket"), "corr").unionByName(c.select(F.col("b").alias("basket"), "corr")).groupBy("basket").agg(F.avg("corr").alias("mean_corr"))
    return risk.ann_stats(ew, ["basket"], "r", 0.0, 12).join(both, "basket").select("basket", F.round("ann_ret", 6).alias("ret"), F.round("ann_vol", 6).alias("vol"), *r6("mean_corr"))


@query(_BASKET + " SELECT basket, entity, count(*) AS n, round(avg(r) * 12, 6) AS ret, round(stddev_samp(r) * sqrt(12), 6) AS vol, round(exp(sum(ln(1 + r))) - 1, 5) AS total FROM m GROUP BY 1, 2", "rets", "sect")
def a75_member_returns(spark, d):
    m = rets(spark, d).where("r IS NOT NULL").join(_members(spark, d), "entity")
    return m.groupBy("basket", "entity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r") * 12, 6).alias("ret"), F.round(F.stddev_samp("r") * 12**0.5, 6).alias("vol"), F.round(F.exp(F.sum(F.log1p("r"))) - 1, 5).alias("total"))


_LEG_RATES = ", ".join(f"round(avg(CASE WHEN coalesce({c} {op} {screens.THRESHOLDS['normal'][k]}, false) THEN 0.0::DOUBLE ELSE 1 END), 6) AS {k}_fails" for k, (c, op) in screens.LEGS.items())


@query(f", t AS (SELECT f.*, g.regime FROM fund f ASOF JOIN regime g ON f.as_of >= g.date) SELECT regime, count(*) AS n, {_LEG_RATES} FROM t GROUP BY 1", "regime", "fund")
def a76_leg_fail_rates(spark, d):
    """How often each leg fails at the filings of each regime's dates."""
    f = fund(spark, d)
    days = asof.asof(f.select("as_of").distinct(), regime(spark, d), "as_of", "date", ["regime"], []).where("regime IS NOT NULL")
    x = screens.with_legs(f.join(F.broadcast(days), "as_of"))
    return x.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg((~F.col(f"pass_{k}")).cast("double")), 6).alias(f"{k}_fails") for k in screens.LEGS])


@query(_BASKET + " SELECT basket, regime, count(*) AS n, round(avg(b), 6) AS mean, round(stddev_samp(b), 6) AS vol FROM ew JOIN regime USING (date) GROUP BY 1, 2", "regime", "sect")
def a76_basket_by_regime(spark, d):
    ew = returns.group_returns(rets(spark, d), _members(spark, d), "entity", "basket", "date", "r").drop("n")
    return ew.join(regime(spark, d), "date").groupBy("basket", "regime").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.stddev_samp("r"), 6).alias("vol"))


@query(", s AS (SELECT lag(regime) OVER w AS f, regime AS t, m - lag(m) OVER w AS d1, m - lag(m, 5) OVER w AS d5 FROM regime WINDOW w AS (ORDER BY date)) SELECT f AS \"from\", t AS \"to\", count(*) AS n, round(avg(d1), 6) AS d1, round(avg(d5), 6) AS d5 FROM s WHERE f <> t GROUP BY 1, 2", "regime")
def a77_transition_triggers(spark, d):
    return regimes.triggers(regime(spark, d), "date", "regime", "m").select("from", "to", "n", *r6("d1", "d5"))


@query(", s AS (SELECT regime AS f, lead(regime) OVER (ORDER BY date) AS t FROM regime), g AS (SELECT f, t, count(*) AS n FROM s WHERE t IS NOT NULL GROUP BY 1, 2) SELECT f AS \"from\", t AS \"to\", n, round(n / sum(n) OVER (PARTITION BY f), 6) AS share FROM g", "regime")
def a78_transition_shares(spark, d):
    return regimes.transitions(regime(spark, d), "date", "regime").select("from", "to", "n", *r6("share"))


@query(" SELECT regime, count(*) AS n, round(avg(m) * 12, 6) AS ret, round(stddev_samp(m) * sqrt(12), 6) AS vol, round(min(m), 6) AS worst, max(date) AS newest, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM regime GROUP BY 1", "regime")
def a78_state_summary(spark, d):
    g = regime(spark, d).groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("m") * 12, 6).alias("ret"), F.round(F.stddev_samp("m") * 12**0.5, 6).alias("vol"), F.round(F.min("m"), 6).alias("worst"), F.max("date").alias("newest"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # one row per state


@query()
def a79_mixture_states(spark, d):
    """Gaussian mixture of MLlib over market features; SQL can't fit it, so its test checks labels, order and posteriors."""
    m = market(spark, d)
    w = Window.orderBy("date").rowsBetween(-5, 0)  # one row per date
    p = pairs.rolling_corr(pairs.paired(returns.group_returns(rets(spark, d), _members(spark, d), "entity", "basket", "date", "r"), "basket", "date", "r", []), [], "date", 12)
    corr = p.groupBy("date").agg(F.avg("corr").alias("corr"))
    x = m.withColumn("vol", F.stddev_samp("m").over(w)).join(corr, "date").where("vol IS NOT NULL AND corr IS NOT NULL")
    return regimes.mixture_labels(x, ["m", "vol", "corr"], "vol", 2).select("date", "state", F.round(F.array_max("posterior"), 4).alias("p_max"))


_PK = [f"least(greatest(p{k}, 1e-12::DOUBLE), 1)" for k in (1, 2, 3)]
_POST = ", p AS (SELECT entity, as_of, amount, stab AS p1, (1 - stab) * 0.7::DOUBLE AS p2, (1 - stab) * 0.3::DOUBLE AS p3 FROM fund), pn AS (SELECT *, " + ", ".join(f"{x} / ({' + '.join(_PK)}) AS n{k}" for k, x in enumerate(_PK, 1)) + " FROM p), e AS (SELECT *, -(" + " + ".join(f"n{k} * ln(n{k})" for k in (1, 2, 3)) + ") / ln(3) AS h, greatest(p1, p2, p3) AS top FROM pn)"
_STATES = ["low_vol", "normal", "high_vol_stress"]


def _posteriors(spark, d):
    p = F.array(F.col("stab"), (1 - F.col("stab")) * 0.7, (1 - F.col("stab")) * 0.3)
    return fund(spark, d).select("entity", "as_of", "amount", p.alias("p")).withColumn("h", regimes.entropy(F.col("p"))).withColumn("top", F.array_max("p"))


@query(_POST + " SELECT entity, as_of, round(h, 6) + 0.0 AS entropy, round(top, 6) AS top, CASE WHEN top < 0.7 THEN 'uncertain' WHEN p1 = top THEN 'low_vol' WHEN p2 = top THEN 'normal' ELSE 'high_vol_stress' END AS label FROM e", "fund")
def a80_posterior_entropy(spark, d):
    return _posteriors(spark, d).select("entity", "as_of", (F.round("h", 6) + 0.0).alias("entropy"), *r6("top"), regimes.soft_label(F.col("p"), _STATES).alias("label"))


@query(_POST + ", x AS (SELECT *, lead(amount) OVER (PARTITION BY entity ORDER BY as_of) AS nxt, CASE WHEN h <= 0 THEN NULL WHEN h <= 0.3 THEN 'low' WHEN h <= 0.6 THEN 'mid' ELSE 'high' END AS bin FROM e) SELECT bin, round(avg(nxt), 2) AS next_mean, round(stddev_samp(nxt), 2) AS next_std, count(nxt) AS n FROM x WHERE bin IS NOT NULL GROUP BY 1", "fund")
def a80_entropy_bins(spark, d):
    """What follows on low, middle and high entropy: the next row's value."""
    x = _posteriors(spark, d).withColumn("nxt", F.lead("amount").over(Window.partitionBy("entity").orderBy("as_of"))).withColumn("bin", regimes.entropy_bin(F.col("h"))).where("bin IS NOT NULL")
    return x.groupBy("bin").agg(F.round(F.avg("nxt"), 2).alias("next_mean"), F.round(F.stddev_samp("nxt"), 2).alias("next_std"), F.count("nxt").alias("n"))


@query(_POST + " SELECT entity, as_of, round(h, 6) + 0.0 AS entropy, round(top, 6) AS top FROM e WHERE top < 0.7", "fund")
def a80_uncertain_days(spark, d):
    return _posteriors(spark, d).where(F.col("top") < regimes.SOFT).select("entity", "as_of", (F.round("h", 6) + 0.0).alias("entropy"), *r6("top"))


_LEADS = ", ".join(f"round(corr(h, v{k}), 6) AS lead_{k}" for k in range(11))


@query(_POST + ", t AS (SELECT as_of, avg(h) AS h, avg(amount) AS v FROM e GROUP BY 1), l AS (SELECT h, " + ", ".join(f"lead(v, {k}) OVER (ORDER BY as_of) AS v{k}" for k in range(11)) + f" FROM t) SELECT {_LEADS} FROM l", "fund")
def w27_entropy_leads(spark, d):
    """Correlation of the mean entropy with the mean amount so many dates later; one row per date."""
    t = _posteriors(spark, d).groupBy("as_of").agg(F.avg("h").alias("h"), F.avg("amount").alias("v"))
    w = Window.orderBy("as_of")
    l = t.select("h", *[F.lead("v", k).over(w).alias(f"v{k}") for k in range(11)])
    return l.agg(*[F.round(safe_corr(F.col("h"), F.col(f"v{k}")), 6).alias(f"lead_{k}") for k in range(11)])


@query(_POST + """, f AS (SELECT entity, as_of, h, h > 0.8 AS u, h - lag(h) OVER w AS dh, avg(h) OVER (PARTITION BY entity ORDER BY as_of ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS h5 FROM e WINDOW w AS (PARTITION BY entity ORDER BY as_of)) SELECT entity, as_of, round(dh, 6) AS dh, round(h5, 6) AS h5 FROM f""", "fund")
def w27_entropy_dynamics(spark, d):
    w = Window.partitionBy("entity").orderBy("as_of")
    return _posteriors(spark, d).select("entity", "as_of", F.round(F.col("h") - F.lag("h").over(w), 6).alias("dh"), F.round(F.avg("h").over(w.rowsBetween(-4, 0)), 6).alias("h5"))


@query(_POST + """, f AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY as_of) AS rn FROM e), i AS (SELECT *, rn - row_number() OVER (PARTITION BY entity ORDER BY as_of) AS isl FROM f WHERE h > 0.8) SELECT entity, min(as_of) AS start, max(as_of) AS "end", count(*) AS n FROM i GROUP BY entity, isl""", "fund")
def w27_uncertainty_spells(spark, d):
    return windows.spells(_posteriors(spark, d).withColumn("u", F.col("h") > 0.8), "entity", "as_of", "u").select("entity", "start", "end", "n")


@query(""", s AS (SELECT date, regime FROM regime), w AS (SELECT a.date, b.regime, count(*) AS n FROM (SELECT date, row_number() OVER (ORDER BY date) AS k FROM s) a JOIN (SELECT date, regime, row_number() OVER (ORDER BY date) AS k FROM s) b ON b.k BETWEEN a.k - 19 AND a.k GROUP BY 1, 2) SELECT date, regime AS majority FROM w QUALIFY row_number() OVER (PARTITION BY date ORDER BY n DESC, regime) = 1""", "regime")
def w45_majority_regime(spark, d):
    return regimes.majority(regime(spark, d), None, "date", "regime", 20).select("date", "majority")


@query(""", p AS (SELECT entity, date, price, count(*) OVER (PARTITION BY entity) AS n, ln(price / lag(price) OVER (PARTITION BY entity ORDER BY date)) AS lr FROM bars WHERE price > 1), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM p WHERE lr IS NOT NULL), v AS (SELECT entity, CASE WHEN max(n) >= 10 AND count(*) >= 3 THEN stddev_samp(lr) * sqrt(252) END AS vol FROM k WHERE rn <= 60 GROUP BY 1), w AS (SELECT entity, count(*) AS windows FROM bars GROUP BY 1), m AS (SELECT median(vol) AS med FROM v)
 SELECT w.entity, CASE WHEN vol IS NULL THEN 1000 ELSE CAST(least(greatest(round_even(1000 * (vol / med) * sqrt(windows / 60.0::DOUBLE), 0), 250), 4000) AS BIGINT) END AS steps FROM w LEFT JOIN v USING (entity), m""", "bars")
def w39_volatility_allocation(spark, d):
    b = bars(spark, d)
    windows_ = b.groupBy("entity").agg(F.count(F.lit(1)).alias("windows"))
    return risk.volatility_steps(b, "entity", "date", "price", windows_, base=1000, rows=60, ref=60, floor=250, ceil=4000).select("entity", "steps")
