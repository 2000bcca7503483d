"""Screens, scores, decisions and their histories over dated ratios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import pct_rank
from tessera.operators import risk, screens
from tessera.plans.common import fund, latest, query, r6, rets
from tessera.registry import table

_INV = lambda c, t: f"(CASE WHEN {c} IS NULL THEN 0.0 WHEN {c} <= {t} THEN 1.0 ELSE least(greatest(1 - ({c} - {t}) / ({t} * 1.5), 0), 1) END)"
_CLIP = lambda x: f"least(greatest({x}, 0), 1)"
_V = f"(0.4::DOUBLE * {_INV('ev', '9.0::DOUBLE')} + 0.3::DOUBLE * {_INV('pb', '1.5::DOUBLE')} + 0.3::DOUBLE * {_INV('mca', '0.5::DOUBLE')})"
_Q15 = f"(0.35::DOUBLE * coalesce(CASE WHEN roe IS NOT NULL THEN {_CLIP('roe / 0.25')} END, 0) + 0.35::DOUBLE * coalesce(CASE WHEN roic IS NOT NULL THEN {_CLIP('roic / 0.25')} END, 0) + 0.15::DOUBLE * coalesce({_CLIP('1 - de / 2')}, 0) + 0.15::DOUBLE * coalesce(stab, 0))"
_Q16 = f"(0.30::DOUBLE * coalesce(CASE WHEN roe IS NOT NULL THEN {_CLIP('roe / 0.25')} END, 0) + 0.30::DOUBLE * coalesce(CASE WHEN roic IS NOT NULL THEN {_CLIP('roic / 0.25')} END, 0) + 0.15::DOUBLE * coalesce({_CLIP('1 - de / 2')}, 0.5) + 0.15::DOUBLE * coalesce(stab, 0.5) + 0.10::DOUBLE * coalesce({_CLIP('ic / 15')}, 0.5))"
_FLAGS = "coalesce(roe >= 0.15, false) AS p_roe, coalesce(roic >= 0.15, false) AS p_roic, coalesce(de <= 1.0, false) AS p_de, coalesce(ev <= 9.0, false) AS p_ev, coalesce(pb <= 1.5, false) AS p_pb, coalesce(mca <= 0.5, false) AS p_mca"
_NAMES = ["roe", "roic", "de", "ev", "pb", "mca"]
_FAILED = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT p_{k} THEN '{k}' END" for k in _NAMES) + ")"
_NFAIL = "(" + " + ".join(f"CAST(NOT p_{k} AS INTEGER)" for k in _NAMES) + ")"
_SCORED = f""", s AS (SELECT *, {_FLAGS}, {_Q16} AS q, {_V} AS v FROM latest), s2 AS (SELECT *, p_roe AND p_roic AND p_de AS buffett, p_ev AND p_pb AND p_mca AS trifecta,
 CASE WHEN NOT coalesce(mca <= 0.5, false) THEN '' WHEN de > 1 THEN 'levered-assets' WHEN de <= 0.5 AND (ic IS NULL OR ic >= 5) THEN 'cheap-assets' WHEN de <= 1 THEN 'mixed-assets' ELSE 'low-MCA' END AS flag FROM s),
 s3 AS (SELECT *, CASE WHEN buffett AND trifecta THEN least(1, 0.55::DOUBLE * q + 0.45::DOUBLE * v + 0.08::DOUBLE) ELSE 0.55::DOUBLE * q + 0.45::DOUBLE * v END AS c0 FROM s2),
 s4 AS (SELECT *, CASE flag WHEN 'cheap-assets' THEN least(1, c0 + 0.03::DOUBLE) WHEN 'levered-assets' THEN greatest(0, c0 - 0.10::DOUBLE) WHEN 'low-MCA' THEN greatest(0, c0 - 0.02::DOUBLE) ELSE c0 END AS score FROM s3),
 ends AS (SELECT entity, count(*) AS n, min_by(roe, as_of) AS roe_a, max_by(roe, as_of) AS roe_z, min_by(roic, as_of) AS roic_a, max_by(roic, as_of) AS roic_z, min_by(stab, as_of) AS stab_a, max_by(stab, as_of) AS stab_z FROM fund WHERE roe IS NOT NULL AND roic IS NOT NULL AND stab IS NOT NULL GROUP BY 1),
 dem AS (SELECT entity, n >= 4 AND CAST(roe_a > 0 AND roe_z <> 0 AND roe_z < roe_a * 0.7 AS INTEGER) + CAST(roic_a > 0 AND roic_z <> 0 AND roic_z < roic_a * 0.7 AS INTEGER) + CAST(stab_a > 0 AND stab_z <> 0 AND stab_z < stab_a * 0.5 AS INTEGER) >= 2 AS demoted FROM ends),
 s5 AS (SELECT s4.*, coalesce(demoted, false) AS demoted FROM s4 LEFT JOIN dem USING (entity)),
 decided AS (SELECT *, CASE WHEN buffett AND trifecta AND NOT demoted AND coalesce(stab >= 0.5, false) AND NOT (flag = 'levered-assets' AND (ic IS NULL OR ic < 5)) THEN 'INCLUDE_CORE' WHEN trifecta AND score >= 0.45 THEN 'INCLUDE_VALUE'
  WHEN buffett AND score >= 0.55 THEN 'INCLUDE_QUALITY' WHEN score >= 0.50 THEN 'SATELLITE' WHEN score >= 0.35 THEN 'WATCH' ELSE 'AVOID' END AS decision FROM s5)"""


def _decided(spark, d):
    demoted = screens.trend_demotion(fund(spark, d), "entity", "as_of")
    return screens.decide(latest(spark, d).join(demoted, "entity", "left").withColumn("demoted", F.coalesce("demoted", F.lit(False))))


@query(f", s AS (SELECT *, {_FLAGS} FROM latest) SELECT entity, p_roe AS pass_roe, p_mca AS pass_mca, {_NFAIL} AS n_failed, {_FAILED} AS failed_legs, {_NFAIL} = 0 AS dual_pass FROM s", "latest")
def p11_screen_legs(spark, d):
    return screens.with_legs(latest(spark, d)).select("entity", "pass_roe", "pass_mca", "n_failed", "failed_legs", "dual_pass")


_POLICY = "(VALUES " + ", ".join(f"('{k}', {', '.join(f'{x}::DOUBLE' for x in v.values())})" for k, v in screens.THRESHOLDS.items()) + ") t(regime, t_roe, t_roic, t_de, t_ev, t_pb, t_mca)"
_PASS = "coalesce(roe >= t_roe, false) AND coalesce(roic >= t_roic, false) AND coalesce(de <= t_de, false) AND coalesce(ev <= t_ev, false) AND coalesce(pb <= t_pb, false) AND coalesce(mca <= t_mca, false)"


@query(f""", x AS (SELECT *, CASE WHEN greatest(stab, 1 - stab) < 0.7 THEN 'uncertain' WHEN ev < 6 THEN 'high_vol_stress' WHEN ev > 9 THEN 'low_vol' ELSE 'normal' END AS regime FROM latest)
 SELECT entity, regime, {_PASS} AS ok, round(roe - t_roe, 6) AS roe_gap, round(t_ev - ev, 6) AS ev_gap FROM x JOIN {_POLICY} USING (regime)""", "latest")
def p12_regime_policy(spark, d):
    x = latest(spark, d).withColumn("label", F.expr("CASE WHEN ev < 6 THEN 'high_vol_stress' WHEN ev > 9 THEN 'low_vol' ELSE 'other' END"))
    x = x.withColumn("regime", screens.select_regime(F.array(F.col("stab"), 1 - F.col("stab")), F.col("label"))).join(F.broadcast(screens.policy(spark)), "regime")
    lim = {k: F.col(f"t_{k}") for k in screens.LEGS}
    return screens.with_legs(x, lim).withColumns(screens.gaps(lim)).select("entity", "regime", F.col("dual_pass").alias("ok"), *r6("roe_gap", "ev_gap"))


@query("SELECT entity, round(roe - 0.15, 6) AS roe_gap, round(roic - 0.15, 6) AS roic_gap, round(1.0 - de, 6) AS de_gap, round(9.0 - ev, 6) AS ev_gap, round(1.5 - pb, 6) AS pb_gap, round(0.5 - mca, 6) AS mca_gap FROM latest", "latest")
def p13_threshold_gaps(spark, d):
    g = screens.gaps()
    return latest(spark, d).withColumns(g).select("entity", *r6(*g))


@query(f", s AS (SELECT *, {_FLAGS} FROM latest) SELECT entity, 'normal' AS regime, {_NFAIL} AS n_failed, {_FAILED} AS failed_legs, round(roe - 0.15, 6) AS roe_gap FROM s", "latest")
def p14_evaluate_universe(spark, d):
    return screens.with_legs(latest(spark, d)).withColumns(screens.gaps()).select("entity", F.lit("normal").alias("regime"), "n_failed", "failed_legs", *r6("roe_gap"))


@query(f"SELECT entity, round({_Q15}, 6) AS q, round({_V}, 6) AS v, round(0.55 * {_Q15} + 0.45 * {_V}, 6) AS composite FROM latest", "latest")
def p15_quality_value_composite(spark, d):
    x = latest(spark, d).withColumns({"q": screens.quality_part(), "v": screens.value_score()})
    return x.withColumn("composite", screens.composite(F.col("q"), F.col("v"))).select("entity", *r6("q", "v", "composite"))


@query(f"SELECT entity, round({_Q16}, 6) AS quality_score, coalesce(roe >= 0.15 AND roic >= 0.15 AND de <= 1.0, false) AS buffett FROM latest", "latest")
def p16_quality_score(spark, d):
    return latest(spark, d).select("entity", F.round(screens.quality_score(), 6).alias("quality_score"), (screens.leg("roe") & screens.leg("roic") & screens.leg("de")).alias("buffett"))


@query(f"SELECT entity, round({_V}, 6) AS value_score, coalesce(ev <= 9.0, false) AS p_ev, coalesce(pb <= 1.5, false) AS p_pb, coalesce(mca <= 0.5, false) AS p_mca FROM latest", "latest")
def p17_value_score(spark, d):
    return latest(spark, d).select("entity", F.round(screens.value_score(), 6).alias("value_score"), *[screens.leg(k).alias(f"p_{k}") for k in ("ev", "pb", "mca")])


@query(_SCORED + " SELECT entity, flag, round(de / (1 + de), 6) AS debt_to_assets, round(1 + de, 6) AS multiplier, round(score - c0, 6) AS adjustment FROM s4", "fund", "latest")
def p18_leverage(spark, d):
    x = _decided(spark, d).withColumns({"debt_to_assets": F.col("de") / (1 + F.col("de")), "multiplier": 1 + F.col("de")})
    c0 = F.when(F.col("buffett") & F.col("trifecta"), F.least(F.lit(1.0), screens.composite(F.col("q"), F.col("v")) + 0.08)).otherwise(screens.composite(F.col("q"), F.col("v")))
    return x.withColumn("adjustment", F.col("score") - c0).select("entity", "flag", *r6("debt_to_assets", "multiplier", "adjustment"))


@query(_SCORED + """ SELECT entity, round(least(CASE WHEN score >= 0.75 THEN 0.12::DOUBLE WHEN score >= 0.60 THEN 0.08 WHEN score >= 0.45 THEN 0.05 ELSE 0.03 END, stab / 10), 6) AS cap,
 CASE WHEN score >= 0.75 THEN 'prefer_add' WHEN score >= 0.70 THEN 'hold_or_add' WHEN score >= 0.50 THEN 'hold' ELSE 'reduce_or_avoid' END AS action FROM s4""", "fund", "latest")
def p19_sizing(spark, d):
    return _decided(spark, d).select("entity", F.round(screens.size_cap(F.col("score"), F.col("stab") / 10), 6).alias("cap"), screens.size_action(F.col("score")).alias("action"))


@query(_SCORED + " SELECT entity, round(q, 6) AS q, round(v, 6) AS v, round(score, 6) AS score, demoted, decision FROM decided", "fund", "latest")
def p20_decision_table(spark, d):
    return _decided(spark, d).select("entity", *r6("q", "v", "score"), "demoted", "decision")


@query(f", s AS (SELECT *, {_FLAGS} FROM latest), t AS (SELECT unnest(string_split({_FAILED}, ',')) AS leg FROM s) SELECT leg, count(*) AS n FROM t WHERE leg <> '' GROUP BY 1", "latest")
def p22_failed_leg_histogram(spark, d):
    x = screens.with_legs(latest(spark, d)).select(F.explode(F.split("failed_legs", ",")).alias("leg")).where("leg <> ''")
    return x.groupBy("leg").agg(F.count(F.lit(1)).alias("n"))


@query(f""", c AS (SELECT c_custkey AS entity, c_mktsegment AS segment FROM customer) SELECT entity, segment, round(0.55 * {_Q15} + 0.45 * {_V}, 6) AS composite, rank() OVER (ORDER BY round(0.55 * {_Q15} + 0.45 * {_V}, 6) DESC) AS rank
 FROM latest JOIN c USING (entity) WHERE segment IN ('MACHINERY', 'BUILDING') QUALIFY rank <= 50""", "latest")
def p23_explore_segment(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment")).where(F.col("segment").isin("MACHINERY", "BUILDING"))
    x = latest(spark, d).join(c, "entity").withColumn("composite", F.round(screens.composite(screens.quality_part(), screens.value_score()), 6))
    # A top-50 report: rows from the 50th value on, with all that tie with it.
    low = x.orderBy(F.desc("composite")).limit(50).agg(F.min("composite").alias("_low"), F.bool_or(F.col("composite").isNull()).alias("_short"))
    top = x.join(F.broadcast(low), F.col("_short") | (F.col("composite") >= F.col("_low")))
    return top.withColumn("rank", F.rank().over(Window.orderBy(F.desc("composite"))).cast("long")).where("rank <= 50").select("entity", "segment", "composite", "rank")


#: The one-at-a-time grid of thresholds, and named scenarios.
_GRID = {"roe": [0.10, 0.12, 0.15, 0.18, 0.20], "roic": [0.10, 0.12, 0.15, 0.18], "de": [0.5, 1.0, 1.5, 2.0], "ev": [7.0, 9.0, 12.0, 15.0], "pb": [1.0, 1.5, 2.0, 3.0], "mca": [0.3, 0.5, 0.8, 1.2]}
_NAMED = {"tight": [0.18, 0.18, 0.5, 7.0, 1.0, 0.3], "base": [0.15, 0.15, 1.0, 9.0, 1.5, 0.5], "relaxed_quality": [0.12, 0.12, 1.0, 9.0, 1.5, 0.5], "relaxed_value": [0.15, 0.15, 1.0, 12.0, 2.0, 0.8], "relaxed_both": [0.12, 0.12, 1.5, 12.0, 2.0, 0.8], "buffett_fair": [0.15, 0.15, 1.0, 15.0, 3.0, 1.5]}
_BASE = screens.THRESHOLDS["normal"]
_SCEN = [("one_at_a_time", k, str(v), *(_BASE | {k: v}).values()) for k, values in _GRID.items() for v in values] + [("scenario", k, "", *v) for k, v in _NAMED.items()] + [("drop", k, "", *(_BASE | {k: None}).values()) for k in _BASE]
_SCEN_SQL = "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else "NULL" if x is None else f"{x}::DOUBLE" for x in r) + ")" for r in _SCEN) + ") t(mode, param, value, t_roe, t_roic, t_de, t_ev, t_pb, t_mca)"
_HOLDS = " AND ".join(f"(t_{k} IS NULL OR coalesce({c} {op} t_{k}, false))" for k, (c, op) in screens.LEGS.items())
#: Risk of baskets given as rows of mem (basket, entity): their equal-weight series and the members' own.
_MEM_RISK = """, m AS (SELECT basket, entity, date, r FROM rets JOIN mem USING (entity) WHERE r IS NOT NULL), ew AS (SELECT basket, date, avg(r) AS b FROM m GROUP BY 1, 2), pa AS (SELECT *, exp(sum(ln(1 + b)) OVER (PARTITION BY basket ORDER BY date)) AS l FROM ew),
 dd AS (SELECT *, l / max(l) OVER (PARTITION BY basket ORDER BY date) - 1 AS dd FROM pa), e AS (SELECT basket, entity, stddev_samp(r) AS v, covar_samp(r, b) / var_samp(b) AS beta FROM m JOIN ew USING (basket, date) GROUP BY 1, 2),
 risk AS (SELECT basket, vol, max_dd, member_vol, beta FROM (SELECT basket, stddev_samp(b) * sqrt(252) AS vol, min(dd) AS max_dd FROM dd GROUP BY 1) JOIN (SELECT basket, avg(v) * sqrt(252) AS member_vol, avg(beta) AS beta FROM e GROUP BY 1) USING (basket))"""


def _basket_risk(spark, d, members):
    """Risk of baskets (basket, entity) of customers, whose prices are those of the suppliers with their numbers."""
    return risk.basket_risk(rets(spark, d), members, "entity", "basket", "date", "r").drop("n")


@query(f""", sc AS (SELECT *, mode || ':' || param || ':' || value AS basket FROM {_SCEN_SQL}), p AS (SELECT basket, mode, param, value, entity, {_HOLDS} AS ok FROM latest, sc), mem AS (SELECT basket, entity FROM p WHERE ok){_MEM_RISK},
 b AS (SELECT entity FROM p WHERE ok AND basket = 'scenario:base:'), g AS (SELECT basket, mode, param, value, count(*) FILTER (ok) AS n, count(*) FILTER (ok AND entity NOT IN (SELECT entity FROM b)) AS n_new FROM p GROUP BY 1, 2, 3, 4)
 SELECT mode, param, value, n, n - (SELECT count(*) FROM b) AS delta, n_new, round(vol, 6) AS vol, round(max_dd, 6) AS max_dd, round(member_vol, 6) AS member_vol, round(beta, 6) AS beta FROM g LEFT JOIN risk USING (basket)""", "latest", "rets")
def p24_stress_grid(spark, d):
    """Thresholds changed one at a time, in named scenarios and with a leg dropped: passes, change and new names against the base, risk of the basket."""
    scen = spark.createDataFrame(_SCEN, "mode string, param string, value string, " + ", ".join(f"t_{k} double" for k in screens.LEGS)).withColumn("basket", F.concat_ws(":", "mode", "param", "value"))
    p = screens.stressed(latest(spark, d), scen).select("basket", "mode", "param", "value", "entity", "all_pass")
    base = p.where("all_pass AND basket = 'scenario:base:'").select("entity", F.lit(True).alias("in_base"))
    g = p.join(base, "entity", "left").groupBy("basket", "mode", "param", "value").agg(F.count_if("all_pass").alias("n"), F.count_if(F.col("all_pass") & F.col("in_base").isNull()).alias("n_new"))
    n0 = base.agg(F.count(F.lit(1)).alias("n0"))
    out = g.join(F.broadcast(n0)).join(_basket_risk(spark, d, p.where("all_pass").select("basket", "entity")), "basket", "left")
    return out.select("mode", "param", "value", "n", (F.col("n") - F.col("n0")).alias("delta"), "n_new", *r6("vol", "max_dd", "member_vol", "beta"))


@query(f""", s AS (SELECT *, {_FLAGS} FROM latest), t AS (SELECT *, {_NFAIL} AS nf FROM s), u AS (SELECT entity, nf, leg, ok FROM (SELECT entity, nf, p_roe AS roe, p_roic AS roic, p_de AS de, p_ev AS ev, p_pb AS pb, p_mca AS mca FROM t) UNPIVOT (ok FOR leg IN (roe, roic, de, ev, pb, mca))),
 mem AS (SELECT leg AS basket, entity FROM u WHERE nf - CAST(NOT ok AS INTEGER) = 0 UNION ALL SELECT 'base', entity FROM t WHERE nf = 0){_MEM_RISK},
 g AS (SELECT leg, count(*) FILTER (NOT ok) AS fails, count(*) FILTER (ok) AS passes, count(*) FILTER (nf - CAST(NOT ok AS INTEGER) = 0) AS shadow, count(*) FILTER (NOT ok AND nf = 1) AS only_this FROM u GROUP BY 1)
 SELECT g.*, round(x.vol, 6) AS vol, round(x.max_dd, 6) AS max_dd, round(x.vol - (SELECT vol FROM risk WHERE basket = 'base'), 6) AS vol_delta FROM g LEFT JOIN risk x ON x.basket = leg""", "latest", "rets")
def p25_binding_legs(spark, d):
    """Per leg: fails, passes, names that pass without the leg (and those that only it keeps out), risk of that shadow basket against the base."""
    x = screens.with_legs(latest(spark, d)).select("entity", "n_failed", *[F.col(f"pass_{k}").alias(k) for k in screens.LEGS])
    u = x.unpivot(["entity", "n_failed"], list(screens.LEGS), "leg", "ok")
    shadow = F.col("n_failed") - (~F.col("ok")).cast("int") == 0
    g = u.groupBy("leg").agg(F.count_if(~F.col("ok")).alias("fails"), F.count_if("ok").alias("passes"), F.count_if(shadow).alias("shadow"), F.count_if(~F.col("ok") & (F.col("n_failed") == 1)).alias("only_this"))
    members = u.where(shadow).select(F.col("leg").alias("basket"), "entity").unionByName(x.where("n_failed = 0").select(F.lit("base").alias("basket"), "entity"))
    r = _basket_risk(spark, d, members).select(F.col("basket").alias("leg"), "vol", "max_dd")
    base = r.where("leg = 'base'").agg(F.max("vol").alias("base_vol"))
    return g.join(r, "leg", "left").join(F.broadcast(base)).select("leg", "fails", "passes", "shadow", "only_this", *r6("vol", "max_dd"), F.round(F.col("vol") - F.col("base_vol"), 6).alias("vol_delta"))


@query(f""", s AS (SELECT *, {_FLAGS} FROM latest), t AS (SELECT *, {_NFAIL} AS n_failed, {_FAILED} AS failed_legs FROM s)
 SELECT entity, n_failed, CASE WHEN n_failed = 1 THEN failed_legs END AS failed_leg, round(roe - 0.15, 6) AS roe_gap, round(roic - 0.15, 6) AS roic_gap, round(1.0 - de, 6) AS de_gap, round(9.0 - ev, 6) AS ev_gap, round(1.5 - pb, 6) AS pb_gap, round(0.5 - mca, 6) AS mca_gap FROM t WHERE n_failed > 0""", "latest")
def p25_near_misses(spark, d):
    """Names outside the base set: how far each leg lies from its threshold, and the leg where it is the only one."""
    g = screens.gaps()
    x = screens.with_legs(latest(spark, d)).withColumns(g).where("n_failed > 0")
    return x.select("entity", "n_failed", F.when(F.col("n_failed") == 1, F.col("failed_legs")).alias("failed_leg"), *r6(*g))


@query(f""", s AS (SELECT *, {_FLAGS} FROM latest) SELECT entity, CASE WHEN b AND t THEN 'dual' WHEN b THEN 'quality_only' WHEN t THEN 'value_only' ELSE 'neither' END AS gap, near OR (b AND t) AS near_dual FROM (SELECT entity, p_roe AND p_roic AND p_de AS b, p_ev AND p_pb AND p_mca AS t, coalesce(roe >= 0.12, false) AND coalesce(roic >= 0.10, false) AND coalesce(de <= 1.2, false) AND coalesce(ev <= 10, false) AND coalesce(pb <= 2.0, false) AND coalesce(mca <= 0.9, false) AS near FROM s)
 WHERE entity NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)""", "latest")
def p26_gap_class(spark, d):
    monitored = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("entity"))
    return latest(spark, d).join(monitored, "entity", "left_anti").select("entity", screens.gap_class().alias("gap"), screens.near_dual().alias("near_dual"))


@query("""SELECT entity, round(1 + de, 6) AS multiplier, round(roe / (1 + de), 6) AS operating, round(roe - roe / (1 + de), 6) AS boost, round((roe - roe / (1 + de)) / roe, 6) AS boost_share,
 CASE WHEN roe IS NULL OR de IS NULL THEN 'unknown' WHEN roe < 0 THEN 'negative' WHEN roe < 0.15 THEN 'modest' WHEN 1 + de <= 1.5 THEN 'high_ops' WHEN 1 + de <= 2 THEN 'mixed' ELSE 'leverage_driven' END AS roe_class FROM latest""", "latest")
def p27_dupont(spark, d):
    return screens.dupont(latest(spark, d)).select("entity", *r6("multiplier", "operating", "boost", "boost_share"), "roe_class")


@query(f"SELECT regime, count(*) FILTER ({_PASS}) AS n_pass, regime = 'normal' AS active FROM latest, {_POLICY} GROUP BY 1, 3", "latest")
def p28_all_regimes(spark, d):
    x = latest(spark, d).join(F.broadcast(screens.policy(spark)))
    x = screens.with_legs(x, {k: F.col(f"t_{k}") for k in screens.LEGS})
    return x.groupBy("regime").agg(F.count_if("dual_pass").alias("n_pass")).withColumn("active", F.col("regime") == "normal")


@query("""SELECT c_custkey AS entity, roe IS NOT NULL AS covered, coalesce(CASE WHEN mca >= 1 THEN 'large' WHEN mca >= 0.4 THEN 'mid' ELSE 'small' END, 'none') AS tier FROM customer LEFT JOIN latest ON c_custkey = entity""", "latest")
def p35_member_universe(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"))
    x = c.join(latest(spark, d).withColumn("tier", F.expr("CASE WHEN mca >= 1 THEN 'large' WHEN mca >= 0.4 THEN 'mid' ELSE 'small' END")), "entity", "left")
    tier = F.when(F.col("roe").isNull(), "small").otherwise(F.col("tier"))
    return x.select("entity", F.col("roe").isNotNull().alias("covered"), F.coalesce(tier, F.lit("none")).alias("tier"))


@query(f", s AS (SELECT *, {_FLAGS}, 0.55 * {_Q15} + 0.45 * {_V} AS c FROM fund) SELECT as_of, count(*) AS n, count(*) FILTER (p_roe AND p_roic AND p_de) AS quality, count(*) FILTER (p_ev AND p_pb AND p_mca) AS value, round(median(c), 6) AS median_composite FROM s GROUP BY 1", "fund")
def a64_screen_history(spark, d):
    x = screens.with_legs(fund(spark, d)).withColumn("c", screens.composite(screens.quality_part(), screens.value_score()))
    return x.groupBy("as_of").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("pass_roe AND pass_roic AND pass_de")).alias("quality"), F.count_if(F.expr("pass_ev AND pass_pb AND pass_mca")).alias("value"), F.round(F.median("c"), 6).alias("median_composite"))


@query(f", s AS (SELECT *, {_FLAGS}, 0.55 * {_Q15} + 0.45 * {_V} AS c FROM fund) SELECT entity, round(avg(CAST(p_roe AS DOUBLE)), 6) AS roe_rate, round(avg(CAST(p_pb AS DOUBLE)), 6) AS pb_rate, round(median(c), 6) AS median_composite, round(stddev_samp(c), 6) AS std_composite FROM s GROUP BY 1", "fund")
def a65_screen_persistence(spark, d):
    x = screens.with_legs(fund(spark, d)).withColumn("c", screens.composite(screens.quality_part(), screens.value_score()))
    return x.groupBy("entity").agg(*[F.round(F.avg(F.col(f"pass_{k}").cast("double")), 6).alias(f"{k}_rate") for k in ("roe", "pb")], F.round(F.median("c"), 6).alias("median_composite"), F.round(F.stddev_samp("c"), 6).alias("std_composite"))


@query(f", s AS (SELECT as_of, {_FLAGS} FROM fund), g AS (SELECT as_of, count(*) FILTER (p_ev AND p_pb) AS n FROM s GROUP BY 1) SELECT as_of, n, n - lag(n) OVER (ORDER BY as_of) AS change FROM g", "fund")
def a66_walk_forward(spark, d):
    g = screens.with_legs(fund(spark, d)).groupBy("as_of").agg(F.count_if(F.col("pass_ev") & F.col("pass_pb")).alias("n"))
    return g.withColumn("change", F.col("n") - F.lag("n").over(Window.orderBy("as_of")))


@query("SELECT vertical, count(*) AS n, count(*) FILTER (roe IS NOT NULL) AS covered FROM (SELECT c_mktsegment AS vertical, roe FROM customer LEFT JOIN latest ON c_custkey = entity) GROUP BY 1", "latest")
def a73_coverage(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("vertical")).join(latest(spark, d).select("entity", "roe"), "entity", "left")
    return c.groupBy("vertical").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("roe").isNotNull()).alias("covered"))


@query(""", x AS (SELECT entity, as_of, count(roe) OVER (PARTITION BY as_of) AS n, CASE WHEN roe IS NOT NULL THEN rank() OVER (PARTITION BY as_of ORDER BY roe) + (count(*) OVER (PARTITION BY as_of, roe) - 1) / 2.0 END AS rk FROM fund) SELECT entity, as_of, round(CAST(rk / n AS DOUBLE), 6) AS p FROM x""", "fund")
def w10_percentile_rank(spark, d):
    return fund(spark, d).select("entity", "as_of", F.round(pct_rank(F.col("roe"), Window.partitionBy("as_of")), 6).alias("p"))


