"""Returns, calendars, indexes and rolling windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import div
from tessera.operators import asof, grouped, index, quantiles, regimes, returns, windows
from tessera.plans.common import bars, named_regime, query, r6, rets, sect
from tessera.registry import table

#: Levels as products of the ratios between neighbouring dates of the panel, numbered; the first date has 100.
_LEVEL = """, traded AS (SELECT region, entity, date, dense_rank() OVER (ORDER BY date) AS k, price, qty FROM bars JOIN sect USING (entity) WHERE price > 0),
 step AS (SELECT t.region, t.date, t.k, count(*) AS n_items, sum(t.price * y.qty) / sum(y.price * y.qty) AS lp, sum(t.price * t.qty) / sum(y.price * t.qty) AS pp, sum(t.qty * y.price) / sum(y.qty * y.price) AS lq, sum(t.qty * t.price) / sum(y.qty * t.price) AS pq
  FROM traded t JOIN traded y ON (y.entity, y.region, y.k) = (t.entity, t.region, t.k - 1) WHERE t.qty > 0 AND y.qty > 0 GROUP BY ALL),
 grown AS (SELECT region, date, n_items, product(lp) OVER w AS lp, product(pp) OVER w AS pp, product(lq) OVER w AS lq, product(pq) OVER w AS pq FROM step WINDOW w AS (PARTITION BY region ORDER BY k)
  UNION ALL SELECT DISTINCT f.region, traded.date, CAST(NULL AS BIGINT), 1, 1, 1, 1 FROM (SELECT region, min(k) - 1 AS k FROM step GROUP BY 1) f JOIN traded USING (k)),
 level AS (SELECT region, date, n_items, 100 * lp AS laspeyres_p, 100 * pp AS paasche_p, 100 * sqrt(lp * pp) AS fisher_p, 100 * lq AS laspeyres_q, 100 * pq AS paasche_q, 100 * sqrt(lq * pq) AS fisher_q FROM grown)"""


def _chain(spark, d):
    return index.fisher_chain(bars(spark, d).join(sect(spark, d).select("entity", "region"), "entity"), "entity", "date", "price", "qty", ["region"])


@query(_LEVEL + " SELECT region, date, n_items, " + ", ".join(f"round({k}, 6) AS {k}" for k in index.KINDS) + " FROM level", "bars", "sect")
def w03_fisher_chain(spark, d):
    return _chain(spark, d).select("region", "date", "n_items", *r6(*index.KINDS))


@query(_LEVEL + """, x AS (SELECT region, date, fisher_p AS p, fisher_q AS q, fisher_p * fisher_q AS n, lag(fisher_p) OVER w AS p0, lag(fisher_q) OVER w AS q0, lag(fisher_p, k) OVER w AS p21, lag(fisher_q, k) OVER w AS q21, k FROM (SELECT *, least(21, greatest(5, count(*) OVER (PARTITION BY region) // 10)) AS k FROM level) WINDOW w AS (PARTITION BY region ORDER BY date))
 SELECT region, date, round(p / p0 - 1, 6) AS rate_p, round(q / q0 - 1, 6) AS rate_q, round(n / (p0 * q0) - 1, 6) AS rate_n, abs(round(n / (p0 * q0) - (p / p0) * (q / q0), 6)) AS gap, round(p / 100, 6) AS cum_p, round(q / 100, 6) AS cum_q,
 round(100 * (pow(p / p21, 12.0::DOUBLE / k) - 1), 5) AS ann_p, round(100 * (pow(q / q21, 12.0::DOUBLE / k) - 1), 5) AS ann_q, round(100 * (pow(n / (p21 * q21), 12.0::DOUBLE / k) - 1), 5) AS ann_n FROM x""", "bars", "sect")
def w23_rate_decomposition(spark, d):
    out = index.rates(_chain(spark, d), ["region"], "date", 12)
    return out.select("region", "date", *r6("rate_p", "rate_q", "rate_n"), F.abs(F.round("gap", 6)).alias("gap"), *r6("cum_p", "cum_q"), *[F.round(c, 5).alias(c) for c in ("ann_p", "ann_q", "ann_n")])


@query(_LEVEL + """, ref AS (SELECT region, coalesce(max_by(fisher_p, date) FILTER (date <= DATE '1997-06-15'), min_by(fisher_p, date) FILTER (date > DATE '1997-06-15')) AS v FROM level GROUP BY 1)
 SELECT region, date, round(100 * fisher_p / v, 6) AS rebased FROM level JOIN ref USING (region)""", "bars", "sect")
def w24_rebase(spark, d):
    return returns.rebase(_chain(spark, d).select("region", "date", "fisher_p"), "region", "date", "fisher_p", "1997-06-15").select("region", "date", *r6("rebased"))


@query(""", pq AS (SELECT * FROM bars), dp AS (SELECT date, lag(date) OVER (ORDER BY date) AS d0 FROM (SELECT DISTINCT date FROM pq))
 SELECT a.date, dp.d0 AS date_0, count(*) AS n, round(sum(a.price * b.qty), 2) AS p1q0 FROM pq a JOIN dp ON a.date = dp.date JOIN pq b ON b.date = dp.d0 AND a.entity = b.entity GROUP BY 1, 2""", "bars")
def j01_period_links(spark, d):
    b = bars(spark, d)
    now = b.join(returns.date_pairs(b, "date"), "date")
    was = b.select("entity", F.col("date").alias("date_0"), F.col("qty").alias("q0"))
    return now.join(was, ["entity", "date_0"]).groupBy("date", "date_0").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("price") * F.col("q0")), 2).alias("p1q0"))


@query("SELECT date, lag(date) OVER (ORDER BY date) AS date_0 FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)")
def w01_date_pairs(spark, d):
    return returns.date_pairs(table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")), "date")


@query(""", g AS (SELECT entity, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS DATE) AS date FROM bars GROUP BY 1) SELECT g.entity, g.date, round(last_value(price IGNORE NULLS) OVER (PARTITION BY g.entity ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS price, price IS NULL AS filled FROM g LEFT JOIN bars USING (entity, date)""", "bars")
def w02_forward_fill(spark, d):
    """Every month between an entity's first and last; those without a bar take the one before."""
    b = bars(spark, d)
    grid = b.groupBy("entity").agg(F.explode(F.sequence(F.min("date"), F.max("date"), F.expr("INTERVAL 1 MONTH"))).alias("date"))
    whole = grid.join(b.select("entity", "date", "price"), ["entity", "date"], "left").withColumn("filled", F.col("price").isNull())
    return returns.forward_fill(whole, "entity", "date", "price").select("entity", "date", *r6("price"), "filled")


@query("SELECT entity, date, round(r, 6) AS r, round(lr, 6) AS lr FROM rets", "rets")
def w04_returns(spark, d):
    return rets(spark, d).select("entity", "date", *r6("r", "lr"))


@query("SELECT entity, date, CASE WHEN count(r) OVER w >= 12 THEN round(stddev_samp(r) OVER w * sqrt(252), 6) END AS vol FROM rets WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)", "rets")
def w05_rolling_volatility(spark, d):
    return windows.rolling_vol(rets(spark, d), "entity", "date", "r", 12).select("entity", "date", *r6("vol"))


@query(""", x AS (SELECT entity, date, r, m FROM rets JOIN market USING (date) WHERE r IS NOT NULL), y AS (SELECT *, count(*) OVER w AS n, covar_samp(r, m) OVER w AS c, var_samp(r) OVER w AS vr, var_samp(m) OVER w AS vm
 FROM x WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
 SELECT entity, date, CASE WHEN n >= 12 THEN round(c, 6) END AS cov, CASE WHEN n >= 12 THEN round(c / vm, 6) END AS beta, CASE WHEN n >= 12 THEN round(c / sqrt(vr * vm), 6) END AS corr FROM y""", "rets", "market")
def w06_rolling_beta(spark, d):
    x = rets(spark, d).where("r IS NOT NULL")
    m = x.groupBy("date").agg(F.avg("r").alias("m"))
    return windows.rolling_pair(x.join(m, "date"), "entity", "date", "r", "m", 12).select("entity", "date", *r6("cov", "beta", "corr"))


@query("""SELECT entity, date, round(peak, 6) AS peak, round(price / peak - 1, 6) AS dd, round(min(price / peak - 1) OVER w, 6) AS max_dd
 FROM (SELECT *, max(price) OVER (PARTITION BY entity ORDER BY date) AS peak FROM bars) WINDOW w AS (PARTITION BY entity ORDER BY date)""", "bars")
def w07_drawdown(spark, d):
    return windows.drawdown(bars(spark, d), "entity", "date", "price").select("entity", "date", *r6("peak", "dd", "max_dd"))


@query("SELECT entity, date, round(lead(price, 3) OVER w / price - 1, 6) AS fwd FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)", "bars")
def w08_forward_returns(spark, d):
    return returns.forward(bars(spark, d), "entity", "date", "price", 3).select("entity", "date", *r6("fwd"))


@query("""SELECT entity, date, round(price / lag(price, 6) OVER w - 1, 6) AS h6, round(lag(price, 1) OVER w / lag(price, 12) OVER w - 1, 6) AS skip FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)""", "bars")
def w12_horizon_and_skip_returns(spark, d):
    out = windows.skip_return(returns.horizon(bars(spark, d), "entity", "date", "price", 6, "h6"), "entity", "date", "price", 12, 1)
    return out.select("entity", "date", *r6("h6", "skip"))


@query(""", x AS (SELECT entity, date, price / lag(price, 6) OVER (PARTITION BY entity ORDER BY date) - 1 AS r, count(*) OVER (PARTITION BY entity) AS n FROM bars), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM x WHERE r IS NOT NULL AND n >= 30), y AS (SELECT *, max(CASE WHEN rn = 1 THEN r END) OVER (PARTITION BY entity) AS now FROM k WHERE rn <= 24)
 SELECT entity, round(avg(CASE WHEN r < now THEN 1.0 ELSE 0 END), 6) AS pctile, round(max(now), 6) AS now, count(*) AS n FROM y GROUP BY 1""", "bars")
def w13_recent_percentile(spark, d):
    return windows.recent_percentile(bars(spark, d), "entity", "date", "price", 6, 24, 30).select("entity", *r6("pctile", "now"), "n")


@query("""SELECT entity, date, CASE WHEN count(r) OVER l >= 12 THEN round(stddev_samp(r) OVER s / stddev_samp(r) OVER l, 6) END AS vol_ratio FROM rets
 WINDOW s AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), l AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""", "rets")
def w14_volatility_ratio(spark, d):
    return windows.vol_ratio(rets(spark, d), "entity", "date", "r", 6, 12).select("entity", "date", *r6("vol_ratio"))


#: Wilder's average as a recursion over each entity's rows, from its second row on.
_RSI = """, n AS (SELECT entity, date, price, row_number() OVER (PARTITION BY entity ORDER BY date) AS k, price - lag(price) OVER (PARTITION BY entity ORDER BY date) AS step FROM bars),
 rec AS (SELECT entity, date, k, greatest(step, 0) AS up, greatest(-step, 0) AS down FROM n WHERE k = 2 UNION ALL SELECT n.entity, n.date, n.k, up + (greatest(n.step, 0) - up) / 14, down + (greatest(-n.step, 0) - down) / 14 FROM rec JOIN n ON n.entity = rec.entity AND n.k = rec.k + 1),
 rsi AS (SELECT entity, date, CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END AS rsi FROM rec WHERE k > 14)"""


@query(_RSI + """, f AS (SELECT *, ln(price / lag(price) OVER w) AS lr FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)),
 g AS (SELECT entity, date, round(lr, 6) AS lr1, round(ln(price / lag(price, 5) OVER w), 6) AS lr_s, CASE WHEN count(*) OVER s >= 5 THEN round(avg(price) OVER s, 6) END AS ma_s, CASE WHEN count(*) OVER l >= 20 THEN round(avg(price) OVER l, 6) END AS ma_l,
 CASE WHEN count(*) OVER s >= 5 AND count(*) OVER l >= 20 THEN round(avg(price) OVER s / avg(price) OVER l - 1, 6) END AS ma_ratio, CASE WHEN count(lr) OVER l >= 20 THEN round(stddev_samp(lr) OVER l, 6) END AS vol,
 round((high - low) / price, 6) AS range, CASE WHEN count(*) OVER l >= 20 THEN round((qty - avg(qty) OVER l) / stddev_samp(qty) OVER l, 6) END AS qty_z, round((high + low + price) / 3, 6) AS typical FROM f
 WINDOW w AS (PARTITION BY entity ORDER BY date), s AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), l AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
 SELECT g.*, round(rsi, 5) AS rsi FROM g LEFT JOIN rsi USING (entity, date)""", "bars")
def w17_feature_panel(spark, d):
    b = bars(spark, d)
    out = windows.features(b, "entity", "date", "price", "qty", "high", "low").join(grouped.indicators(b, "entity", "date", "price").select("entity", "date", "rsi"), ["entity", "date"])
    return out.select("entity", "date", *r6("lr1", "lr_s", "ma_s", "ma_l", "ma_ratio", "vol", "range", "qty_z", "typical"), F.round("rsi", 5).alias("rsi"))


@query(""", daily AS (SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS price, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2),
 grid AS (SELECT entity, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily GROUP BY 1), g AS (SELECT g.entity, g.date, price, coalesce(qty, 0) AS qty FROM grid g LEFT JOIN daily USING (entity, date) WHERE isodow(g.date) < 6)
 SELECT entity, date, round(last_value(price IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS price, qty FROM g""".lstrip(", ").replace("daily AS", "WITH daily AS", 1))
def w18_business_day_grid(spark, d):
    li = table(spark, d, "lineitem")
    daily = li.groupBy(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").cast("date").alias("date")).agg(F.avg("l_extendedprice").alias("price"), F.sum("l_quantity").alias("qty"))
    return returns.densify(daily, "entity", "date", "price", "qty").select("entity", "date", F.round("price", 4).alias("price"), "qty")


@query("""SELECT entity, date, channel, round(v, 6) AS v FROM (SELECT entity, date, price, qty, high - low AS range FROM bars) UNPIVOT (v FOR channel IN (price, qty, range))""", "bars")
def w19_long_channels(spark, d):
    b = bars(spark, d).withColumn("range", F.col("high") - F.col("low"))
    return b.unpivot(["entity", "date"], ["price", "qty", "range"], "channel", "v").select("entity", "date", "channel", *r6("v"))


@query(""", s AS (SELECT entity, avg(price) AS mu, stddev_samp(price) AS sd, min(price) AS lo, max(price) AS hi FROM bars GROUP BY 1)
 SELECT entity, date, round((price - mu) / sd, 6) AS z, round((price - lo) / (hi - lo), 6) AS unit, round(price, 6) AS back FROM bars JOIN s USING (entity)""", "bars")
def w20_scale_and_inverse(spark, d):
    b = bars(spark, d)
    s = b.groupBy("entity").agg(F.avg("price").alias("mu"), F.stddev_samp("price").alias("sd"), F.min("price").alias("lo"), F.max("price").alias("hi"))
    z = b.join(s, "entity").withColumn("z", div(F.col("price") - F.col("mu"), F.col("sd"))).withColumn("unit", div(F.col("price") - F.col("lo"), F.col("hi") - F.col("lo")))
    return z.withColumn("back", F.col("z") * F.col("sd") + F.col("mu")).select("entity", "date", *r6("z", "unit", "back"))


@query(""", m AS (SELECT date, avg(r) AS m, stddev_samp(r) AS dispersion, """ + ", ".join(f"avg(r) FILTER (region = {k}) AS group_{k}" for k in range(5)) + """ FROM rets JOIN sect USING (entity) WHERE r IS NOT NULL GROUP BY 1)
 SELECT date, """ + ", ".join(f"round(group_{k}, 6) AS group_{k}" for k in range(5)) + """, round(m, 6) AS m, round(dispersion, 6) AS dispersion, CASE WHEN count(*) OVER w >= 6 THEN round(stddev_samp(m) OVER w, 6) END AS vol FROM m WINDOW w AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""", "rets", "sect")
def w21_exogenous_channels(spark, d):
    regions = sorted(r.r_regionkey for r in table(spark, d, "region").select("r_regionkey").distinct().collect())
    x = rets(spark, d).where("r IS NOT NULL").join(sect(spark, d), "entity")
    groups = [f"group_{k}" for k in regions]
    m = x.groupBy("date").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("dispersion"), *[F.avg(F.when(F.col("region") == k, F.col("r"))).alias(f"group_{k}") for k in regions])
    w = Window.orderBy("date").rowsBetween(-5, 0)  # one row per date
    return m.withColumn("vol", F.when(F.count("m").over(w) >= 6, F.stddev_samp("m").over(w))).select("date", *r6("m", "dispersion", "vol", *groups))


@query(""", a AS (SELECT entity, date, lr, qty, CASE WHEN count(*) OVER w >= 10 THEN price - median(price) OVER w END AS res FROM rets WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 z AS (SELECT entity, date, CASE WHEN count(lr) OVER w >= 10 AND stddev_samp(lr) OVER w > 0 THEN (lr - avg(lr) OVER w) / stddev_samp(lr) OVER w END AS ret_z, CASE WHEN count(res) OVER w >= 10 AND stddev_samp(res) OVER w > 0 THEN res / stddev_samp(res) OVER w END AS resid_z,
  CASE WHEN count(*) OVER w >= 5 AND stddev_samp(qty) OVER w > 0 THEN (qty - avg(qty) OVER w) / stddev_samp(qty) OVER w END AS vol_z FROM a WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 disp AS (SELECT date, stddev_samp(lr) AS d FROM rets WHERE lr IS NOT NULL GROUP BY 1), shock AS (SELECT date, d / avg(d) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS shock FROM disp),
 s AS (SELECT *, greatest(abs(ret_z), abs(resid_z), abs(vol_z)) AS score FROM z)
 SELECT entity, date, round(ret_z, 5) AS ret_z, round(resid_z, 5) AS resid_z, round(vol_z, 5) AS vol_z, round(score, 5) AS score, coalesce(score >= 3, false) AS is_anomaly, round(shock, 6) AS market_shock FROM s LEFT JOIN shock USING (date)""", "rets")
def w22_anomaly_score(spark, d):
    out = windows.anomalies(bars(spark, d), "entity", "date", "price", "qty")
    return out.select("entity", "date", *[F.round(c, 5).alias(c) for c in ("ret_z", "resid_z", "vol_z", "score")], "is_anomaly", *r6("market_shock"))


@query(", v AS (SELECT date, " + ", ".join(f"CASE WHEN count(*) OVER w{k} >= {k} THEN 100 * stddev_samp(m) OVER w{k} * sqrt(252) END AS vol_{k}" for k in (3, 6, 9, 12, 18)) + " FROM market WINDOW " + ", ".join(f"w{k} AS (ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (3, 6, 9, 12, 18)) + """)
 SELECT date, round(vol_3, 6) AS vol_3, round(vol_6, 6) AS vol_6, round(vol_9, 6) AS vol_9, round(vol_12, 6) AS vol_12, round(vol_18, 6) AS vol_18, round(vol_18 - vol_9, 6) AS slope_long, round(vol_9 - vol_6, 6) AS slope_short, vol_18 - vol_9 > 0 AS contango, vol_18 - vol_9 < 0 AS backwardation, round((vol_6 + vol_18) / 2 - vol_9, 6) AS convexity FROM v""", "market")
def w28_term_structure(spark, d):
    m = rets(spark, d).where("r IS NOT NULL").groupBy("date").agg(F.avg("r").alias("m")).withColumn("universe", F.lit("all"))
    rows = [3, 6, 9, 12, 18]
    return windows.term_structure(m, "universe", "date", "m", rows, 6, 9, 18).select("date", *r6(*[f"vol_{k}" for k in rows], "slope_long", "slope_short"), "contango", "backwardation", *r6("convexity"))


@query("SELECT entity, as_of, round(roe, 6) AS roe, round(amount, 2) AS amount FROM latest", "latest")
def a01_latest_per_key(spark, d):
    from tessera.plans.common import latest

    return latest(spark, d).select("entity", "as_of", *r6("roe"), F.round("amount", 2).alias("amount"))


@query("SELECT sector, date, round(avg(r), 6) AS r, count(*) AS n FROM rets JOIN sect USING (entity) WHERE r IS NOT NULL GROUP BY 1, 2", "rets", "sect")
def a03_group_returns(spark, d):
    return returns.group_returns(rets(spark, d), sect(spark, d), "entity", "sector", "date", "r").select("sector", "date", *r6("r"), "n")


@query(", g AS (SELECT sector, date, avg(r) AS r FROM rets JOIN sect USING (entity) WHERE r IS NOT NULL GROUP BY 1, 2) SELECT sector, date, round(100 * exp(sum(ln(greatest(1 + r, 1e-12))) OVER (PARTITION BY sector ORDER BY date)), 6) AS level FROM g", "rets", "sect")
def a04_group_levels(spark, d):
    return returns.levels(returns.group_returns(rets(spark, d), sect(spark, d), "entity", "sector", "date", "r"), "sector", "date", "r").select("sector", "date", *r6("level"))


@query(", g AS (SELECT sector, date, avg(r) AS r FROM rets JOIN sect USING (entity) WHERE r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 4) SELECT sector, date, round(100 * exp(sum(ln(greatest(1 + r, 1e-12))) OVER (PARTITION BY sector ORDER BY date)), 6) AS level FROM g", "rets", "sect")
def a05_basket_levels(spark, d):
    return returns.levels(returns.group_returns(rets(spark, d), sect(spark, d), "entity", "sector", "date", "r", 4), "sector", "date", "r").select("sector", "date", *r6("level"))


@query("SELECT date, " + ", ".join(f'round(max(CASE WHEN region = {k} THEN p END), 6) AS "{k}"' for k in range(5)) + " FROM (SELECT date, region, avg(price) AS p FROM bars JOIN sect USING (entity) GROUP BY 1, 2) GROUP BY 1", "bars", "sect")
def a06_pivot_wide(spark, d):
    """A column for each region of the table."""
    keys = sorted(r.r_regionkey for r in table(spark, d, "region").select("r_regionkey").distinct().collect())
    p = bars(spark, d).join(sect(spark, d), "entity").groupBy("date", "region").agg(F.avg("price").alias("p"))
    return p.groupBy("date").pivot("region", keys).agg(F.round(F.first("p"), 6))


@query("SELECT entity, date, round(price, 6) AS price, qty, round(high, 6) AS high, round(low, 6) AS low FROM bars", "bars")
def a07_period_bars(spark, d):
    return bars(spark, d).select("entity", "date", *r6("price"), "qty", *r6("high", "low"))


@query(""", e AS (SELECT max(date) AS month_end FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) GROUP BY date_trunc('month', date)), l AS (SELECT month_end, coalesce(CASE g.regime WHEN 'high' THEN 'high_vol_stress' WHEN 'low' THEN 'low_vol' ELSE g.regime END, 'normal') AS regime FROM e ASOF LEFT JOIN regime g ON e.month_end >= g.date)
 SELECT month_end, regime, CASE WHEN regime = 'high_vol_stress' THEN 'reduced_rebalance' ELSE 'full_rebalance' END AS action, CASE WHEN regime = 'high_vol_stress' THEN 0.5 ELSE 1.0 END::DOUBLE AS turnover_band FROM l""", "regime")
def a38_rebalance_plan(spark, d):
    """What each month's last trading date does, by the regime known on it."""
    e = returns.month_ends(table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct(), "date").select("month_end")
    return regimes.rebalance_plan(asof.asof(e, named_regime(spark, d), "month_end", "date", ["regime"], [])).select("month_end", "regime", "action", "turnover_band")


@query("SELECT CAST(date_trunc('month', date) AS DATE) AS month, max(date) AS month_end FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) GROUP BY 1")
def a38_month_ends(spark, d):
    return returns.month_ends(table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct(), "date")


@query(""", x AS (SELECT date, avg(r) AS r, count(*) AS n FROM rets WHERE r IS NOT NULL GROUP BY 1), f AS (SELECT median(roe) AS roe, median(pb) AS pb FROM latest)
 SELECT date, n, round(100 * exp(sum(ln(1 + r)) OVER (ORDER BY date)), 6) AS level, round(roe, 6) AS median_roe, round(pb, 6) AS median_pb FROM x, f""", "rets", "latest")
def a74_index_snapshots(spark, d):
    from tessera.plans.common import latest

    x = rets(spark, d).where("r IS NOT NULL").groupBy("date").agg(F.avg("r").alias("r"), F.count(F.lit(1)).alias("n")).withColumn("u", F.lit(1))
    f = latest(spark, d).select("roe", "pb").unpivot([], ["roe", "pb"], "metric", "v")
    f = quantiles.medians(f, ["metric"], "v", "m").agg(*[F.max(F.when(F.col("metric") == c, F.col("m"))).alias(f"median_{c}") for c in ("roe", "pb")]).withColumn("u", F.lit(1))
    return returns.levels(x, "u", "date", "r").join(f, "u").select("date", "n", *r6("level", "median_roe", "median_pb"))


@query("SELECT * EXCLUDE (rn) FROM (SELECT entity, date, round(price, 6) AS price, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM bars) WHERE rn <= 3", "bars")
def t02_last_rows_per_entity(spark, d):
    return returns.last_rows(bars(spark, d), "entity", "date", 3).select("entity", "date", *r6("price"))


@query("SELECT entity, year, last_price, qty FROM (SELECT entity, CAST(year(date) AS BIGINT) AS year, round(max_by(price, date), 6) AS last_price, sum(qty) AS qty FROM bars GROUP BY 1, 2)", "bars")
def a07_last_price_by_year(spark, d):
    out = returns.last_in_period(bars(spark, d), "year", "entity", "date", "price", "qty")
    return out.select("entity", F.year("period").cast("long").alias("year"), F.round("price", 6).alias("last_price"), "qty")
