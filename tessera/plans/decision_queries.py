"""Decisions, scores and views over screened customers, and ratios from statements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import clip, div
from tessera.operators import asof, backtest, decisions, returns
from tessera.operators.ranks import with_pct_ranks
from tessera.plans import risk_queries, screen_queries
from tessera.plans.common import bars, fund, latest, panels_once, query, r6, regime, rets
from tessera.registry import table
from tessera.scratch import cut

_SIDES = f", sd AS (SELECT *, p_roe AND p_roic AND p_de AS quality, p_ev AND p_pb AND p_mca AS value, {screen_queries._NFAIL} AS n_failed, {screen_queries._FAILED} AS failed_legs FROM (SELECT *, {screen_queries._FLAGS} FROM latest))"


@query(_SIDES + """ SELECT entity, n_failed, failed_legs, n_failed BETWEEN 1 AND 2 AS near, c_custkey IS NOT NULL AS monitored,
 CASE WHEN quality AND value THEN CASE WHEN stab < 0.25 THEN 'EXCLUDE' ELSE 'INCLUDE' END WHEN quality OR value THEN 'INCLUDE' WHEN n_failed >= 5 THEN 'EXCLUDE' ELSE 'WATCH' END AS candidacy,
 CASE WHEN quality AND value THEN CASE WHEN stab < 0.25 THEN 'WATCH' ELSE 'INCLUDE_CORE' END WHEN value THEN 'INCLUDE_VALUE' WHEN quality THEN 'INCLUDE_QUALITY' WHEN n_failed <= 2 THEN 'NEAR_DUAL' WHEN n_failed >= 5 THEN 'AVOID' ELSE 'WATCH' END AS decision
 FROM sd LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = entity""", "latest")
def p21_inclusion(spark, d):
    own = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("entity"), F.lit(True).alias("own"))
    return decisions.inclusion(latest(spark, d)).join(own, "entity", "left").select("entity", "n_failed", "failed_legs", "near", F.col("own").isNotNull().alias("monitored"), "candidacy", "decision")


#: What the score reads of the suppliers, under the customer's number: momentum, residual, composite, liquidity, fragility.
_INPUTS = f""", mo AS (WITH {risk_queries._MOM[2:]} SELECT entity, score AS momentum, round(resid3, 6) AS residual FROM q), ag AS (WITH {risk_queries._COMPOSITE[2:]} SELECT entity, composite AS aggregate FROM cp),
 fz AS (SELECT entity, as_of, round(0.4 * {risk_queries._ZF('1 / nullif(ev, 0)')} + 0.4 * {risk_queries._ZF('roe')} + 0.2 * {risk_queries._ZF('-de')}, 6) AS factor FROM fund WINDOW p AS (PARTITION BY as_of)), fl AS (SELECT entity, factor FROM fz QUALIFY row_number() OVER (PARTITION BY entity ORDER BY as_of DESC) = 1),
 li AS (SELECT entity, round((rank() OVER (ORDER BY dv) + (count(*) OVER (PARTITION BY dv) - 1) / 2.0) / count(*) OVER (), 6) AS liquidity FROM (SELECT entity, avg(price * qty) AS dv FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM bars WHERE qty > 0) WHERE rn <= 21 GROUP BY 1)),
 fr AS (WITH {risk_queries._FRAGILE[2:]} SELECT entity, flagged AS fragile FROM fg), st AS (SELECT max_by(regime, date) = 'high' AS stress FROM regime),
 inp AS (SELECT decided.entity, decision, flag, momentum, residual, factor, aggregate, liquidity, coalesce(fragile, false) AS fragile, stab AS skew, c_mktsegment = 'BUILDING' AS member, stress FROM decided LEFT JOIN mo USING (entity) LEFT JOIN ag USING (entity) LEFT JOIN fl USING (entity) LEFT JOIN li USING (entity) LEFT JOIN fr USING (entity) LEFT JOIN customer ON c_custkey = entity, st)"""


def _buy_sql() -> str:
    """The terms as sums of CASE expressions, one for each name."""
    names = list(dict.fromkeys(t[0] for t in decisions.BUY_TERMS))
    of = lambda n: [t for t in decisions.BUY_TERMS if t[0] == n]
    points = " + ".join("CASE " + " ".join(f"WHEN {c} THEN {p}::DOUBLE" for _, c, p, _ in of(n)) + " ELSE 0 END" for n in names)
    words = ", ".join("CASE " + " ".join(f"WHEN {c} THEN " + (f"'{w}'" if w else "NULL") for _, c, _, w in of(n)) + " END" for n in names if any(t[3] for t in of(n)))
    return f", sc AS (SELECT *, round({points}, 9) AS score, concat_ws(',', {words}) AS reasons FROM inp) SELECT entity, score, reasons, CASE WHEN score >= 0.55 THEN 'BUY' WHEN score >= 0.35 THEN 'ACCUMULATE' WHEN score >= 0.15 THEN 'WATCH' ELSE 'AVOID' END AS action FROM sc"


@query(screen_queries._SCORED + _INPUTS + _buy_sql(), "fund", "latest", "market", "regime", "sect")
@panels_once("bars", "fund")
def p29_decision_points(spark, d):
    """All twelve parts. What the customers' tables lack comes from the supplier of the same number; stability stands in for the options' skew."""
    momentum = risk_queries._momentum(spark, d).select("entity", F.col("score").alias("momentum"), F.round("resid3", 6).alias("residual"))
    aggregate = risk_queries.composite(spark, d).select("entity", F.col("composite").alias("aggregate"))
    factor = returns.latest(risk_queries.a24_factor_panel(spark, d), "entity", "as_of").select("entity", F.col("composite").alias("factor"))
    liquid = returns.last_rows(bars(spark, d).where("qty > 0"), "entity", "date", 21).groupBy("entity").agg(F.avg(F.col("price") * F.col("qty")).alias("dv"))
    liquid = with_pct_ranks(cut(liquid, "liquidity"), {"p": "dv"}).select("entity", F.round("p", 6).alias("liquidity"))
    fragile = risk_queries.a63_fragility(spark, d).select("entity", F.col("flagged").alias("fragile"))
    member = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), (F.col("c_mktsegment") == "BUILDING").alias("member"))
    x = screen_queries._decided(spark, d).select("entity", "decision", "flag", F.col("stab").alias("skew"))
    for other in (momentum, aggregate, factor, liquid, fragile, member):
        x = x.join(other, "entity", "left")
    stress = regime(spark, d).agg((F.max_by("regime", "date") == "high").alias("stress"))
    return decisions.buy_score(x.join(F.broadcast(stress))).select("entity", "score", "reasons", "action")  # stress is one row


_VIEWS = screen_queries._SCORED + """, st AS (SELECT max_by(regime, date) = 'high' AS stress FROM regime), v0 AS (SELECT entity, stress, flag, CASE WHEN decision = 'INCLUDE_CORE' OR (buffett AND trifecta) THEN 0.04::DOUBLE WHEN decision = 'INCLUDE_VALUE' THEN 0.02 WHEN decision = 'INCLUDE_QUALITY' THEN 0.025 WHEN decision = 'AVOID' THEN -0.02 ELSE 0 END AS v,
 CASE WHEN decision = 'INCLUDE_CORE' OR (buffett AND trifecta) THEN 0.6::DOUBLE WHEN decision = 'INCLUDE_VALUE' THEN 0.4 WHEN decision = 'INCLUDE_QUALITY' THEN 0.45 WHEN decision = 'AVOID' THEN 0.3 ELSE 0 END AS c FROM decided, st),
 vw AS (SELECT entity, round(v * CASE WHEN flag = 'levered-assets' THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN stress THEN 0.4::DOUBLE ELSE 1 END, 4) AS view, round(c * CASE WHEN flag = 'levered-assets' THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN stress THEN 0.5::DOUBLE ELSE 1 END, 3) AS confidence FROM v0)
 SELECT entity, view, confidence, round(greatest(view, 0) * confidence / nullif(sum(greatest(view, 0) * confidence) OVER (), 0), 8) AS weight FROM vw WHERE view <> 0 OR confidence <> 0"""


@query(_VIEWS, "fund", "latest", "regime")
def p30_views(spark, d):
    stress = regime(spark, d).agg((F.max_by("regime", "date") == "high").alias("stress"))
    x = screen_queries._decided(spark, d).select("entity", "decision", "flag", (F.col("buffett") & F.col("trifecta")).alias("dual")).join(F.broadcast(stress))  # one row
    return decisions.view_weights(decisions.views(x)).select("entity", "view", "confidence", F.round("weight", 8).alias("weight"))


@query(""", k AS (SELECT entity, price, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY entity) AS n, min_by(price, date) OVER (PARTITION BY entity) AS first FROM bars), e AS (SELECT entity, max(n) AS n, max(first) AS first, max(price) FILTER (rn = 1) AS last, max(price) FILTER (rn = 9) AS s3, max(price) FILTER (rn = 5) AS s5 FROM k GROUP BY 1),
 now AS (SELECT max_by(regime, date) AS now FROM regime), b AS (SELECT entity, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) AS base FROM rets JOIN regime USING (date), now WHERE r IS NOT NULL AND regime = now GROUP BY 1),
 f AS (SELECT entity, 100 * ((0.6::DOUBLE * (last + (last - first) / (n - 1) * 3) + 0.4::DOUBLE * (SELECT price FROM k k2 WHERE k2.entity = e.entity AND k2.rn = 7)) / last - 1) AS percent FROM e WHERE n >= 10),
 l AS (SELECT entity, percent, base, CASE WHEN round(percent, 6) > 3 THEN 'BULL' WHEN round(percent, 6) < -3 THEN 'BEAR' ELSE 'NEUTRAL' END AS label FROM f LEFT JOIN b USING (entity))
 SELECT entity, round(percent, 6) AS percent, round(base, 6) AS baseline, label, CASE WHEN label = 'BULL' AND round(base, 6) >= 0.6 THEN 'BULL*' WHEN label = 'BEAR' AND round(base, 6) <= 0.4 THEN 'BEAR*' ELSE label END AS gated FROM l""", "regime")
def p31_forecast_labels(spark, d):
    """The newest forecast at the longest horizon, three rows ahead, against each entity's share of rises in the present regime."""
    now = regime(spark, d).agg(F.max_by("regime", "date").alias("now"))
    rises = rets(spark, d).where("r IS NOT NULL").join(regime(spark, d).select("date", "regime"), "date").join(F.broadcast(now)).where("regime = now")  # one row
    base = rises.groupBy("entity").agg(F.round(F.avg((F.col("r") > 0).cast("double")), 6).alias("baseline"))
    f = backtest.drift_seasonal(bars(spark, d), "entity", "date", "price", [3]).where("n >= 10").select("entity", F.round(100 * (F.col("forecast") / F.col("last") - 1), 6).alias("percent"))
    label, gated = decisions.forecast_label(F.col("percent"), F.col("baseline"))
    return f.join(base, "entity", "left").select("entity", "percent", "baseline", label.alias("label"), gated.alias("gated"))


_LINES = """, li AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS goods, sum(l_extendedprice * l_discount) AS off, sum(l_extendedprice * l_tax) AS tax, sum(l_quantity) AS qty, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS back, sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END) AS done, count(*) AS lines FROM lineitem GROUP BY 1),
 qs AS (SELECT o_custkey AS entity, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS as_of, sum(goods) AS assets, sum(off) AS oi, sum(off) - sum(tax) / 4 AS ni, sum(qty) AS da, sum(tax) / 10 AS interest, sum(tax) / 8 AS tax, sum(back) AS debt, sum(done) / 20 AS cash, sum(goods) - sum(back) AS equity, sum(lines) AS shares FROM orders JOIN li ON o_orderkey = k GROUP BY 1, 2),
 ty AS (SELECT entity, as_of, assets, debt, cash, equity, shares, """ + ", ".join(f"CASE WHEN count(*) OVER w = 4 THEN sum({c}) OVER w END AS {n}" for c, n in (("ni", "ttm_ni"), ("oi", "ttm_oi"), ("da", "ttm_da"), ("interest", "ttm_int"), ("tax", "ttm_tax"))) + """ FROM qs WINDOW w AS (PARTITION BY entity ORDER BY as_of ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
 pr AS (SELECT t.*, CAST(t.as_of + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS qend FROM ty t), st AS (SELECT pr.*, b.price, CASE WHEN abs(ttm_oi - ttm_int) > 1e-9 THEN least(greatest(ttm_tax / (ttm_oi - ttm_int), 0), 0.5) END AS rate FROM pr ASOF LEFT JOIN bars b ON pr.entity = b.entity AND pr.qend >= b.date)
 SELECT entity, qend, round(price * shares, 4) AS market_cap, round(nullif(ttm_ni, 0) / nullif(equity, 0), 6) AS roe, round(nullif(coalesce(nullif(ttm_oi, 0) * (1 - coalesce(rate, 0.25)), ttm_ni + nullif(ttm_int, 0) * (1 - coalesce(rate, 0.25))), 0) / nullif(debt + equity, 0), 6) AS roic, round(nullif(debt, 0) / nullif(equity, 0), 6) AS de,
 round(nullif(price * shares + debt - cash, 0) / nullif(coalesce(ttm_oi + ttm_da, ttm_oi), 0), 6) AS ev_ebitda, round(price * shares / nullif(equity, 0), 6) AS pb, round(price * shares / nullif(assets, 0), 6) AS mca, round(nullif(ttm_oi, 0) / nullif(ttm_int, 0), 6) AS coverage FROM st"""


def _statements(spark, d):
    """Quarterly statements of each customer from the lines of their orders; profit lines are sums over four quarters."""
    x = F.col("l_extendedprice")
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(x).alias("goods"), F.sum(x * F.col("l_discount")).alias("off"), F.sum(x * F.col("l_tax")).alias("taxed"), F.sum("l_quantity").alias("qty"),
        F.sum(F.when(F.col("l_returnflag") == "R", x).otherwise(0.0)).alias("back"), F.sum(F.when(F.col("l_linestatus") == "F", x).otherwise(0.0)).alias("done"), F.count(F.lit(1)).alias("lines"),
    )
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("as_of")).join(li, "o_orderkey")
    q = o.groupBy("entity", "as_of").agg(
        F.sum("goods").alias("assets"), F.sum("off").alias("oi"), (F.sum("off") - F.sum("taxed") / 4).alias("ni"), F.sum("qty").alias("da"), (F.sum("taxed") / 10).alias("interest"), (F.sum("taxed") / 8).alias("tax"),
        F.sum("back").alias("debt"), (F.sum("done") / 20).alias("cash"), (F.sum("goods") - F.sum("back")).alias("equity"), F.sum("lines").alias("shares"), F.lit(None).cast("double").alias("invested"),
    )
    w = Window.partitionBy("entity").orderBy("as_of").rowsBetween(-3, 0)
    return q.withColumns({n: F.when(F.count(F.lit(1)).over(w) == 4, F.sum(c).over(w)) for c, n in (("ni", "ttm_ni"), ("oi", "ttm_oi"), ("da", "ttm_da"), ("interest", "ttm_int"), ("tax", "ttm_tax"))})


@query(_LINES, "bars")
def p32_statement_ratios(spark, d):
    """Ratios at each quarter's end, with the last price of the supplier of the customer's number on or before it."""
    st = _statements(spark, d).withColumn("qend", F.date_sub(F.add_months("as_of", 3), 1))
    pretax = F.col("ttm_oi") - F.col("ttm_int")
    st = st.withColumn("tax_rate", F.when(F.abs(pretax) > 1e-9, clip(div(F.col("ttm_tax"), pretax), 0, 0.5)))
    priced = asof.asof(st, bars(spark, d).select("entity", "date", "price"), "qend", "date", ["price"], ["entity"])
    return decisions.ratios(priced).select("entity", "qend", F.round("market_cap", 4).alias("market_cap"), *r6("roe", "roic", "de", "ev_ebitda", "pb", "mca", "coverage"))


def _strength_sql() -> str:
    parts = decisions.STRENGTH.items()
    total = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w}::DOUBLE * least(greatest(({c} - {lo}::DOUBLE) / {hi - lo}::DOUBLE, 0), 1) END" for c, (w, lo, hi) in parts if hi > lo)
    weight = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w}::DOUBLE END" for c, (w, _, _) in parts)
    return f"round(coalesce(({total}) / nullif({weight}, 0), 0), 4)"


@query(_SIDES + f""" SELECT entity, {_strength_sql()} AS strength, CASE WHEN quality AND value AND de <= 1 AND ic >= 3 THEN 'dual_strong' WHEN quality AND value THEN 'dual_weak' WHEN quality THEN 'quality_only' WHEN value THEN 'value_only' ELSE 'neither' END AS tier,
 coalesce(amount >= 150000 AND roe > 0, false) AND c_mktsegment IS NOT NULL AS eligible FROM sd LEFT JOIN customer ON c_custkey = entity""", "latest")
def p34_membership_strength(spark, d):
    """Size is the amount of the newest quarter, sector the customer's segment."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment")
    x = decisions.membership(latest(spark, d).join(c, "entity", "left"), F.col("amount"), 150000.0, F.col("c_mktsegment"))
    return x.select("entity", "strength", "tier", "eligible")
