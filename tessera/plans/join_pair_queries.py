"""Joins by time and key, and statistics of pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import safe_corr
from tessera.operators import asof, blocks, pairs, quantiles, regimes, returns, windows
from tessera.plans.common import bars, fund, latest, named_regime, query, r6, regime, rets, sect
from tessera.registry import table
from tessera.scratch import cut, shuffle_parts

#: Lines that one task of J12 holds, about: a fixed number of tasks would hold more of a larger table.
EVENT_ROWS = 500_000


@query(""", q AS (SELECT o_orderkey, o_custkey AS entity, CAST(o_orderdate AS DATE) AS t FROM orders)
 SELECT o_orderkey, f.as_of, round(f.roe, 6) AS roe FROM q ASOF LEFT JOIN (SELECT entity, as_of + 45 AS known, as_of, roe FROM fund) f ON q.entity = f.entity AND q.t >= f.known""", "fund")
def j06_asof_join(spark, d):
    q = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"), F.col("o_orderdate").cast("date").alias("t"))
    f = fund(spark, d).withColumn("known", F.date_add("as_of", 45))
    return asof.asof(q, f, "t", "known", ["as_of", "roe"], ["entity"]).select("o_orderkey", "as_of", *r6("roe"))


@query(""", q AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS t FROM orders) SELECT o_orderkey, g.regime FROM q ASOF LEFT JOIN regime g ON q.t >= g.date""", "regime")
def j07_regime_tags(spark, d):
    q = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("t"))
    days = asof.asof(q.select("t").distinct(), regime(spark, d), "t", "date", ["regime"], [])
    return q.join(days, "t").select("o_orderkey", "regime")


@query(""", q AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) + 14 AS t FROM orders), l AS (SELECT q.t, coalesce(CASE g.regime WHEN 'high' THEN 'high_vol_stress' WHEN 'low' THEN 'low_vol' ELSE g.regime END, 'normal') AS regime FROM q ASOF LEFT JOIN regime g ON q.t >= g.date)
 SELECT t, regime, CASE WHEN regime = 'high_vol_stress' THEN 'reduced_rebalance' ELSE 'full_rebalance' END AS action, CASE WHEN regime = 'high_vol_stress' THEN 0.5 ELSE 1.0 END::DOUBLE AS turnover_band FROM l""", "regime")
def j08_calendar_state(spark, d):
    q = table(spark, d, "orders").select(F.date_add(F.date_trunc("month", "o_orderdate").cast("date"), 14).alias("t")).distinct()
    return regimes.rebalance_plan(asof.asof(q, named_regime(spark, d), "t", "date", ["regime"], [])).select("t", "regime", "action", "turnover_band")


_MEMB = """, days AS (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date FROM orders), a AS (SELECT o_custkey AS entity, min(CAST(o_orderdate AS DATE)) AS ad FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
 g AS (SELECT o_custkey AS entity, min(CAST(o_orderdate AS DATE)) AS rm FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), m AS (SELECT date, entity FROM (SELECT entity, coalesce(ad, DATE '1900-01-01') AS ad, rm FROM a FULL JOIN g USING (entity)) JOIN days ON ad <= date AND (rm IS NULL OR rm > date))"""


def _members(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").cast("date").alias("t"), "o_orderstatus")
    days = o.select(F.date_trunc("quarter", "t").cast("date").alias("date"))
    return asof.members_at(days, "date", o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'P'"), "entity", "t")


@query("WITH x AS (SELECT 1)" + _MEMB + " SELECT * FROM m")
def j09_interval_membership(spark, d):
    return _members(spark, d)


@query("WITH x AS (SELECT 1)" + _MEMB + """, act AS (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, o_custkey AS entity FROM orders), j AS (SELECT coalesce(m.date, act.date) AS date, m.entity IS NOT NULL AS pred, act.entity IS NOT NULL AS actual FROM m FULL JOIN act ON m.date = act.date AND m.entity = act.entity)
 SELECT date, count(*) FILTER (pred AND actual) AS tp, count(*) FILTER (pred AND NOT actual) AS fp, count(*) FILTER (actual AND NOT pred) AS fn, round(count(*) FILTER (pred AND actual) / nullif(count(*) FILTER (pred), 0), 6) AS precision, round(count(*) FILTER (pred AND actual) / nullif(count(*) FILTER (actual), 0), 6) AS recall FROM j GROUP BY 1""")
def a72_membership_quality(spark, d):
    act = table(spark, d, "orders").select(F.date_trunc("quarter", "o_orderdate").cast("date").alias("date"), F.col("o_custkey").alias("entity")).distinct().withColumn("a", F.lit(True))
    j = _members(spark, d).withColumn("p", F.lit(True)).join(act, ["date", "entity"], "full_outer").select("date", F.coalesce("p", F.lit(False)).alias("p"), F.coalesce("a", F.lit(False)).alias("a"))
    g = j.groupBy("date").agg(F.count_if(F.col("p") & F.col("a")).alias("tp"), F.count_if(F.col("p") & ~F.col("a")).alias("fp"), F.count_if(~F.col("p") & F.col("a")).alias("fn"))
    return g.select("*", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


@query(", x AS (SELECT entity, count(*) AS n FROM rets GROUP BY 1) SELECT entity, sector, region, n FROM sect LEFT JOIN x USING (entity) WHERE entity IN (SELECT l_suppkey FROM lineitem)", "rets", "sect")
def j02_feature_joins(spark, d):
    x = rets(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    traded = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"))
    return sect(spark, d).join(x, "entity", "left").join(traded, "entity", "left_semi").select("entity", "sector", "region", "n")  # J05: the semi join


@query(", a AS (SELECT entity, roe, pb FROM latest) SELECT coalesce(a.entity, sect.entity) AS entity, round(roe, 6) AS roe, round(pb, 6) AS pb, region FROM a FULL JOIN sect ON a.entity = sect.entity", "latest", "sect")
def j03_full_outer_latest(spark, d):
    """Newest ratios of customers beside the suppliers of their numbers: customers without a supplier, suppliers whose customer has no orders."""
    return latest(spark, d).select("entity", "roe", "pb").join(sect(spark, d).select("entity", "region"), "entity", "full_outer").select("entity", *r6("roe", "pb"), "region")


@query(""", a AS (SELECT date, entity, r FROM rets WHERE r IS NOT NULL), b AS (SELECT CAST(date + INTERVAL 1 MONTH AS DATE) AS date, entity, high - low AS spread FROM bars) SELECT date, entity, round(r, 6) AS r, round(spread, 6) AS spread FROM a FULL JOIN b USING (date, entity)""", "rets")
def j04_factor_outer_join(spark, d):
    """Returns beside the spread of the month before: each has dates that the other lacks."""
    a = rets(spark, d).where("r IS NOT NULL").select("date", "entity", "r")
    b = bars(spark, d).select(F.add_months("date", 1).alias("date"), "entity", (F.col("high") - F.col("low")).alias("spread"))
    return a.join(b, ["date", "entity"], "full_outer").select("date", "entity", *r6("r", "spread"))


_PAIRS = ", p AS (SELECT x.sector, x.date, x.entity AS a, y.entity AS b, x.r AS x, y.r AS y FROM (SELECT * FROM rets JOIN sect USING (entity) WHERE r IS NOT NULL) x JOIN (SELECT * FROM rets JOIN sect USING (entity) WHERE r IS NOT NULL) y ON x.sector = y.sector AND x.date = y.date AND x.entity < y.entity)"


#: Entity, time, value and group of the pair statistics.
_IN_SECTOR = ("entity", "date", "r", ["sector"])


def _grouped(spark, d):
    return rets(spark, d).join(sect(spark, d).select("entity", "sector"), "entity")


@query(_PAIRS + " SELECT sector, a, b, count(*) AS n FROM p GROUP BY 1, 2, 3", "rets", "sect")
def j10_pairs_in_groups(spark, d):
    return blocks.pair_stats(_grouped(spark, d), *_IN_SECTOR, 1).select("sector", "a", "b", "n")


@query(_PAIRS + " SELECT sector, a, b, count(*) AS n, round(corr(x, y), 6) AS corr, round(covar_samp(x, y), 8) AS cov, round(regr_slope(y, x), 6) AS beta, round(regr_intercept(y, x), 6) AS alpha FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 20", "rets", "sect")
def j11_all_pair_statistics(spark, d):
    return blocks.pair_stats(_grouped(spark, d), *_IN_SECTOR, 20).select("sector", "a", "b", "n", *r6("corr"), F.round("cov", 8).alias("cov"), *r6("beta", "alpha"))


@query(""", ev AS (SELECT DISTINCT o_orderkey, l_suppkey AS entity, CAST(o_orderdate AS DATE) AS t FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey), n AS (SELECT *, lead(price, 5) OVER w / price - 1 AS r1, lead(price, 20) OVER w / price - 1 AS r2, lead(price, 63) OVER w / price - 1 AS r3 FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)),
 x AS (SELECT ev.*, n.date AS d1, n.r1, n.r2, n.r3 FROM ev ASOF LEFT JOIN n ON ev.entity = n.entity AND ev.t >= n.date), y AS (SELECT x.*, n.date AS d2, n.r1 AS s1, n.r2 AS s2, n.r3 AS s3 FROM x ASOF LEFT JOIN n ON x.entity = n.entity AND x.t <= n.date),
 z AS (SELECT *, d1 IS NOT NULL AND (d2 IS NULL OR t - d1 <= d2 - t) AS back FROM y)
 SELECT o_orderkey, entity, CASE WHEN back THEN d1 ELSE d2 END AS observed, round(CASE WHEN back THEN r1 ELSE s1 END, 6) AS ret_5, round(CASE WHEN back THEN r2 ELSE s2 END, 6) AS ret_20, round(CASE WHEN back THEN r3 ELSE s3 END, 6) AS ret_63 FROM z""", "bars")
def j12_nearest_event(spark, d):
    """Every order, once for each of its suppliers, with the returns 5, 20 and 63 rows later; orders without lines have none."""
    lines = table(spark, d, "lineitem")
    tasks = -(-lines.count() // EVENT_ROWS)  # the count reads no column
    tasks = tasks if tasks > shuffle_parts(spark) else None
    deal = lambda df: df.repartition(tasks, "o_orderkey") if tasks else df
    li = deal(lines.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("entity"))).distinct()
    o = deal(table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("t"))).distinct()
    near = asof.nearest(o.join(li, "o_orderkey", "left"), bars(spark, d), "entity", "t", "date", "price", [5, 20, 63], tasks)
    return near.select("o_orderkey", "entity", "observed", *r6("ret_5", "ret_20", "ret_63"))


@query(""" SELECT entity, date, round(last_value(m IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS m FROM bars LEFT JOIN market USING (date)""", "market")
def j13_exogenous_fill(spark, d):
    e = rets(spark, d).where("r IS NOT NULL").groupBy("date").agg(F.avg("r").alias("m"))
    return returns.forward_fill(bars(spark, d).join(e, "date", "left"), "entity", "date", "m").select("entity", "date", *r6("m"))


@query("SELECT CAST(c_custkey AS BIGINT) AS entity, o.k IS NOT NULL AS member, coalesce(n_name, 'none') AS place FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c_custkey = o.k LEFT JOIN nation ON c_nationkey = n_nationkey")
def j14_reconcile_dimension(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("m", F.lit(True))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(o, "c_custkey", "left").join(n, "c_nationkey", "left").select(F.col("c_custkey").alias("entity"), F.col("m").isNotNull().alias("member"), F.coalesce("n_name", F.lit("none")).alias("place"))


@query(""", f AS (SELECT entity, date, lag(price) OVER w AS was, price, avg(price) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS fc FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date))
 SELECT entity, count(*) AS n, round(avg(abs(fc - price)), 6) AS mae, round(avg(CASE WHEN sign(fc - was) = sign(price - was) THEN 1.0 ELSE 0 END), 6) AS hit FROM f WHERE was IS NOT NULL GROUP BY 1""", "bars")
def j15_forecast_score(spark, d):
    w = Window.partitionBy("entity").orderBy("date")
    b = bars(spark, d)
    fc = b.select("entity", "date", F.avg("price").over(w.rowsBetween(-3, -1)).alias("fc"), F.lag("price").over(w).alias("was"))
    j = b.select("entity", "date", "price").join(fc, ["entity", "date"]).where("was IS NOT NULL")
    hit = F.signum(F.col("fc") - F.col("was")) == F.signum(F.col("price") - F.col("was"))
    return j.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("fc") - F.col("price"))), 6).alias("mae"), F.round(F.avg(hit.cast("double")), 6).alias("hit"))


_REG = _PAIRS + ", c AS (SELECT g.regime, sector, a, b, corr(x, y) AS c FROM p JOIN regime g USING (date) GROUP BY ALL HAVING count(*) >= 5)"


def _by_regime(spark, d):
    c = blocks.pair_stats(_grouped(spark, d), *_IN_SECTOR, 5, labels=regime(spark, d).select("date", "regime"))
    return c.select("regime", "sector", "a", "b", F.col("corr").alias("c"))


@query(_REG + " SELECT regime, round(avg(c), 6) AS mean_corr, round(median(c), 6) AS median_corr, count(*) AS n FROM c GROUP BY 1", "regime", "sect")
def a37_regime_correlation(spark, d):
    c = blocks.corr_quantiles(_grouped(spark, d), *_IN_SECTOR, 5, regime(spark, d).select("date", "regime"), {"median_corr": 0.5})
    return c.select("regime", F.round("mean", 6).alias("mean_corr"), *r6("median_corr"), "n")


@query(_REG + " SELECT regime, sector, round(avg(c), 6) AS mean_corr, count(*) AS n FROM c GROUP BY 1, 2", "regime", "sect")
def a37_regime_correlation_by_sector(spark, d):
    return _by_regime(spark, d).groupBy("regime", "sector").agg(F.round(F.avg("c"), 6).alias("mean_corr"), F.count(F.lit(1)).alias("n"))


@query(_REG + " SELECT x.a, x.b, x.regime AS one, y.regime AS two, round(y.c - x.c, 6) AS delta FROM c x JOIN c y ON x.a = y.a AND x.b = y.b AND x.regime < y.regime WHERE x.c IS NOT NULL AND y.c IS NOT NULL", "regime", "sect")
def a37_pair_deltas(spark, d):
    """How each pair's correlation differs between two regimes."""
    c = _by_regime(spark, d).where("c IS NOT NULL").groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("regime", "c"))).alias("r"))  # one entry for each regime
    return c.select("a", "b", F.explode("r").alias("x"), "r").select("a", "b", "x", F.explode("r").alias("y")).where("x.regime < y.regime").select("a", "b", F.col("x.regime").alias("one"), F.col("y.regime").alias("two"), F.round(F.col("y.c") - F.col("x.c"), 6).alias("delta"))


@query(_PAIRS + """, e AS (SELECT date AS end_date, row_number() OVER (ORDER BY date) AS k FROM market), w AS (SELECT end_date, k FROM e WHERE k % 6 = 0 AND k >= 12), q AS (SELECT end_date, a, b, corr(x, y) AS c FROM p JOIN e ON p.date = e.end_date JOIN (SELECT end_date AS we, k AS wk FROM w) ON e.k <= wk AND e.k > wk - 12 GROUP BY ALL HAVING false)
 SELECT we AS window_end, round(avg(c), 6) AS mean_corr, round(quantile_cont(c, 0.25), 6) AS p25, round(quantile_cont(c, 0.75), 6) AS p75 FROM (SELECT we, a, b, corr(x, y) AS c FROM p JOIN e ON p.date = e.end_date JOIN (SELECT end_date AS we, k AS wk FROM w) ON e.k <= wk AND e.k > wk - 12 GROUP BY 1, 2, 3 HAVING count(*) >= 8) GROUP BY 1""", "market", "sect")
def a40_rolling_pair_history(spark, d):
    m = rets(spark, d).where("r IS NOT NULL").select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")))  # one row per date
    ends = m.where("k % 6 = 0 AND k >= 12").select(F.col("date").alias("window_end"), F.explode(F.sequence(F.col("k") - 11, F.col("k"))).alias("k"))
    c = blocks.corr_quantiles(_grouped(spark, d), *_IN_SECTOR, 8, m.join(ends, "k").select("date", "window_end"), {"p25": 0.25, "p75": 0.75})
    return c.select("window_end", F.round("mean", 6).alias("mean_corr"), *r6("p25", "p75"))


@query(_PAIRS + ", e AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS k FROM market) SELECT sector, a, b, count(*) AS n, round(corr(x, y), 6) AS corr FROM p JOIN e USING (date) WHERE k <= 12 GROUP BY 1, 2, 3 HAVING count(*) >= 8", "market", "sect")
def a40_latest_matrix(spark, d):
    """Correlations of all pairs over the last 12 dates."""
    days = rets(spark, d).where("r IS NOT NULL").select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy(F.desc("date")))).where("k <= 12").select("date")  # one row per date
    c = blocks.pair_stats(_grouped(spark, d).join(F.broadcast(days), "date"), *_IN_SECTOR, 8)
    return c.select("sector", "a", "b", "n", *r6("corr"))


_ROLL = _PAIRS + """, rc AS (SELECT sector, a, b, date, CASE WHEN count(*) OVER w >= 12 THEN covar_samp(x, y) OVER w / sqrt(var_samp(x) OVER w * var_samp(y) OVER w) END AS c FROM p WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


@query(_ROLL + " SELECT date, round(avg(c), 6) AS mean_corr, count(c) AS n FROM rc GROUP BY 1", "rets", "sect")
def a41_average_rolling_correlation(spark, d):
    c = blocks.rolling_by_time(_grouped(spark, d), *_IN_SECTOR, [12]).groupBy("date").agg(F.try_divide(F.sum(F.col("mean_corr") * F.col("n")), F.sum("n")).alias("mean_corr"), F.sum("n").alias("n"))
    return c.select("date", *r6("mean_corr"), "n")


_SPANS = (6, 12, 24)
_ROLLS = _PAIRS + ", rw AS (" + " UNION ALL ".join(f"SELECT {k} AS rows, sector, date, CASE WHEN count(*) OVER w{k} >= {k} THEN covar_samp(x, y) OVER w{k} / sqrt(var_samp(x) OVER w{k} * var_samp(y) OVER w{k}) END AS c FROM p WINDOW w{k} AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in _SPANS) + ")"


@query(_ROLLS + " SELECT rows, sector, date, round(avg(c), 6) AS mean_corr, count(c) AS n FROM rw WHERE c IS NOT NULL GROUP BY 1, 2, 3", "rets", "sect")
def a41_sector_rolling_correlation(spark, d):
    """Mean correlation of each sector's pairs over windows of several lengths."""
    return blocks.rolling_by_time(_grouped(spark, d), *_IN_SECTOR, list(_SPANS)).where("n > 0").select("rows", "sector", "date", *r6("mean_corr"), "n")


@query(""", x AS (SELECT entity, date, r, m FROM rets JOIN market USING (date) WHERE r IS NOT NULL), c AS (SELECT entity, date, CASE WHEN count(*) OVER w >= 12 THEN covar_samp(r, m) OVER w / sqrt(var_samp(r) OVER w * var_samp(m) OVER w) END AS c FROM x WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
 SELECT entity, round(avg(c), 6) AS mean, round(stddev_samp(c), 6) AS std, round(max_by(c, date), 6) AS newest FROM c WHERE c IS NOT NULL GROUP BY 1""", "market")
def a41_market_stability(spark, d):
    x = rets(spark, d).where("r IS NOT NULL")
    m = x.groupBy("date").agg(F.avg("r").alias("m"))
    c = windows.rolling_pair(x.join(m, "date"), "entity", "date", "r", "m", 12).where("corr IS NOT NULL")
    return c.groupBy("entity").agg(F.round(F.avg("corr"), 6).alias("mean"), F.round(F.stddev_samp("corr"), 6).alias("std"), F.round(F.max_by("corr", "date"), 6).alias("newest"))


@query(", s AS (SELECT sector, date, avg(r) AS g FROM rets JOIN sect USING (entity) WHERE r IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT -1, date, avg(r) FROM rets WHERE r IS NOT NULL GROUP BY 2) SELECT rets.entity, s.sector, round(corr(r, g), 6) AS corr, s.sector = sect.sector AS home, count(*) AS n FROM rets JOIN s USING (date) JOIN sect ON sect.entity = rets.entity WHERE r IS NOT NULL GROUP BY 1, 2, 4 HAVING count(*) >= 20", "rets", "sect")
def a42_asset_group_correlation(spark, d):
    r, s = rets(spark, d).where("r IS NOT NULL"), sect(spark, d)
    g = returns.group_returns(r, s, "entity", "sector", "date", "r").select("sector", "date", F.col("r").alias("g"))
    whole = r.groupBy("date").agg(F.avg("r").alias("g")).select(F.lit(-1).cast(g.schema["sector"].dataType).alias("sector"), "date", "g")  # the market, as group -1
    c = r.join(g.unionByName(whole), "date").groupBy("entity", "sector").agg(safe_corr(F.col("r"), F.col("g")).alias("corr"), F.count(F.lit(1)).alias("n")).where("n >= 20")
    own = s.select("entity", F.col("sector").alias("own"))
    return c.join(own, "entity").select("entity", "sector", *r6("corr"), (F.col("sector") == F.col("own")).alias("home"), "n")


@query(_ROLL + " SELECT a, b, round(avg(c), 6) AS mean, round(stddev_samp(c), 6) AS std, round(max(c) - min(c), 6) AS span, round(quantile_cont(c, 0.75) - quantile_cont(c, 0.25), 6) AS iqr, round(avg(CASE WHEN c > 0 THEN 1.0 ELSE 0 END), 6) AS positive FROM rc WHERE c IS NOT NULL GROUP BY 1, 2", "rets", "sect")
def a43_correlation_stability(spark, d):
    told = ("mean", "std", "span", "iqr", "positive")
    return blocks.rolling_by_pair(_grouped(spark, d), *_IN_SECTOR, 12, dict.fromkeys(told, 6)).select("a", "b", *told)


@query(", s AS (SELECT sector AS g, date, avg(r) AS r FROM rets JOIN sect USING (entity) WHERE r IS NOT NULL GROUP BY 1, 2) SELECT x.g AS a, y.g AS b, count(*) AS n, round(corr(x.r, y.r), 6) AS corr FROM s x JOIN s y ON x.date = y.date AND x.g < y.g GROUP BY 1, 2", "rets", "sect")
def a44_group_correlation_matrix(spark, d):
    g = returns.group_returns(rets(spark, d), sect(spark, d), "entity", "sector", "date", "r")
    return blocks.pair_stats(g, "sector", "date", "r", []).select("a", "b", "n", *r6("corr"))


@query(_PAIRS + ", q AS (SELECT p.*, g.regime FROM p JOIN regime g USING (date)) SELECT a, b, round(corr(x, y) FILTER (regime = 'low'), 6) AS low, round(corr(x, y) FILTER (regime <> 'low'), 6) AS other, round(corr(x, y) FILTER (regime <> 'low') - corr(x, y) FILTER (regime = 'low'), 6) AS delta FROM q GROUP BY 1, 2 HAVING count(*) FILTER (regime = 'low') > 9 AND count(*) FILTER (regime <> 'low') > 9", "regime", "sect")
def a45_conditional_correlation(spark, d):
    calm = regime(spark, d).select("date", (F.col("regime") == "low").alias("calm"))
    c = blocks.pair_stats(_grouped(spark, d), *_IN_SECTOR, 10, labels=calm)
    low, other = (c.where(k).select("sector", "a", "b", F.col("corr").alias(n)) for n, k in (("low", "calm"), ("other", "NOT calm")))
    return low.join(other, ["sector", "a", "b"]).withColumn("delta", F.col("other") - F.col("low")).select("a", "b", *r6("low", "other", "delta"))


_SHRINK = """, g AS (SELECT region AS e, date, avg(r) AS x FROM rets JOIN sect USING (entity) WHERE r IS NOT NULL GROUP BY 1, 2), z AS (SELECT e, date, x - avg(x) OVER (PARTITION BY e) AS z FROM g),
 s AS (SELECT a.e AS a, b.e AS b, avg(a.z * b.z) AS s, avg(a.z * a.z * b.z * b.z) AS q, count(*) AS n FROM z a JOIN z b ON a.date = b.date AND a.e <= b.e GROUP BY 1, 2),
 t AS (SELECT sum(s) FILTER (a = b) / count(*) FILTER (a = b) AS mu, count(*) FILTER (a = b) AS k, sum(CASE WHEN a = b THEN 1 ELSE 2 END * s * s) AS fro, sum(2 * (q - s * s)) FILTER (a <> b) AS off, max(n) AS t FROM s),
 i AS (SELECT mu, least(greatest(off / (fro - k * mu * mu) / t, 0), 1) AS intensity FROM t)"""


_ESTIMATES = _SHRINK + """, io AS (SELECT least(greatest(((1 - 2.0::DOUBLE / k) * (fro - k * mu * mu) + (k * mu) * (k * mu)) / ((t + 1 - 2.0::DOUBLE / k) * (fro - k * mu * mu)), 0), 1) AS intensity_oas FROM t),
 h AS (SELECT e, date, least(greatest(x, avg(x) OVER w - 2.5::DOUBLE * stddev_samp(x) OVER w), avg(x) OVER w + 2.5::DOUBLE * stddev_samp(x) OVER w) AS h FROM g WINDOW w AS (PARTITION BY e)), wn AS (SELECT a.e AS a, b.e AS b, covar_samp(a.h, b.h) AS winsorised FROM h a JOIN h b ON a.date = b.date AND a.e <= b.e GROUP BY 1, 2),
 est AS (SELECT a, b, s, intensity, intensity * CASE WHEN a = b THEN mu ELSE 0 END + (1 - intensity) * s AS shrunk, intensity_oas, intensity_oas * CASE WHEN a = b THEN mu ELSE 0 END + (1 - intensity_oas) * s AS shrunk_oas, winsorised FROM s JOIN wn USING (a, b), i, io)"""


@query(_ESTIMATES + " SELECT a, b, round(s, 8) AS s, round(intensity, 6) AS intensity, round(shrunk, 8) AS shrunk, round(intensity_oas, 6) AS intensity_oas, round(shrunk_oas, 8) AS shrunk_oas, round(winsorised, 8) AS winsorised FROM est", "rets", "sect")
def a46_shrunk_covariance(spark, d):
    g = returns.group_returns(rets(spark, d), sect(spark, d), "entity", "region", "date", "r")
    e8 = [F.round(c, 8).alias(c) for c in ("s", "shrunk", "shrunk_oas", "winsorised")]
    return pairs.shrinkage(g, "region", "date", "r").select("a", "b", *e8, *r6("intensity", "intensity_oas"))


@query(_ESTIMATES + ", u AS (SELECT a, b, s, estimate, v FROM est UNPIVOT (v FOR estimate IN (shrunk, shrunk_oas, winsorised))) SELECT estimate, round(sqrt(sum(CASE WHEN a = b THEN 1 ELSE 2 END * (v - s) * (v - s))), 7) AS gap, round(sqrt(sum(CASE WHEN a = b THEN 1 ELSE 2 END * (v - s) * (v - s)) / sum(CASE WHEN a = b THEN 1 ELSE 2 END * s * s)), 6) AS relative FROM u GROUP BY 1", "rets", "sect")
def a46_estimate_gaps(spark, d):
    g = returns.group_returns(rets(spark, d), sect(spark, d), "entity", "region", "date", "r")
    out = pairs.frobenius(pairs.shrinkage(g, "region", "date", "r"), "s", ["shrunk", "shrunk_oas", "winsorised"])
    return out.select("estimate", F.round("gap", 7).alias("gap"), *r6("relative"))


@query(_PAIRS + """, o AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY date DESC) - 1 AS k, count(*) OVER (PARTITION BY a, b) AS n FROM p) SELECT a, b, round(sum(CASE WHEN k = n - 1 THEN pow(0.94, k) ELSE 0.06 * pow(0.94, k) END * x * y), 8) AS ewma FROM o GROUP BY 1, 2""", "rets", "sect")
def a47_ewma_covariance(spark, d):
    return blocks.ewma_cov(_grouped(spark, d), *_IN_SECTOR).select("a", "b", F.round("ewma", 8).alias("ewma"))


@query(_SHRINK + ", w AS (SELECT e, 1.0 / count(*) OVER () AS w FROM (SELECT DISTINCT e FROM g)), full_s AS (SELECT a, b, s FROM s UNION ALL SELECT b, a, s FROM s WHERE a <> b), c AS (SELECT a, sum(x.w * y.w * s) AS rc FROM full_s JOIN w x ON x.e = a JOIN w y ON y.e = b GROUP BY 1) SELECT a, round(CAST(rc AS DOUBLE), 8) AS contribution, round(CAST(rc / sum(rc) OVER () AS DOUBLE), 6) AS share FROM c", "rets", "sect")
def a48_risk_contribution(spark, d):
    g = returns.group_returns(rets(spark, d), sect(spark, d), "entity", "region", "date", "r")
    s = pairs.shrinkage(g, "region", "date", "r").select("a", "b", "s")
    whole = s.unionByName(s.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    w = g.select("region").distinct().withColumn("w", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy()))  # one row per asset of the portfolio
    c = whole.join(w.withColumnRenamed("region", "a").withColumnRenamed("w", "wa"), "a").join(w.withColumnRenamed("region", "b").withColumnRenamed("w", "wb"), "b")
    c = c.groupBy("a").agg(F.sum(F.col("wa") * F.col("wb") * F.col("s")).alias("contribution"))
    return c.withColumn("share", F.col("contribution") / F.sum("contribution").over(Window.partitionBy())).select("a", F.round("contribution", 8).alias("contribution"), *r6("share"))


@query(_SHRINK + ", d AS (SELECT a, sqrt(greatest(s, 1e-18)) AS v FROM s WHERE a = b), m AS (SELECT s.a, s.b, s, x.v AS va, y.v AS vb, s / (x.v * y.v) AS c FROM s JOIN d x ON s.a = x.a JOIN d y ON s.b = y.a), k AS (SELECT avg(c) FILTER (a <> b) AS mc FROM m), zz AS (SELECT *, CASE WHEN a = b THEN va * vb ELSE va * vb * least(greatest(c + (0.40::DOUBLE - mc), -1), 1) END AS z FROM m, k) SELECT a, b, round(0.5::DOUBLE * z + 0.5::DOUBLE * s, 8) AS blended, round(0.1::DOUBLE * z + 0.9::DOUBLE * s, 8) AS blended_calm FROM zz", "rets", "sect")
def a51_regime_covariance(spark, d):
    g = returns.group_returns(rets(spark, d), sect(spark, d), "entity", "region", "date", "r")
    s = pairs.shrinkage(g, "region", "date", "r").select("a", "b", "s")
    return pairs.crisis_blend(s, {"blended": True, "blended_calm": False}).select("a", "b", F.round("blended", 8).alias("blended"), F.round("blended_calm", 8).alias("blended_calm"))


@query(_PAIRS + """, q AS (SELECT a, b, quantile_cont(x, 0.1) AS xl, quantile_cont(x, 0.9) AS xu, quantile_cont(y, 0.1) AS yl, quantile_cont(y, 0.9) AS yu FROM p GROUP BY 1, 2 HAVING count(*) >= 20)
 SELECT a, b, round(avg(CASE WHEN x > xu AND y > yu THEN 1.0 ELSE 0 END) / 0.1, 6) AS upper, round(avg(CASE WHEN x < xl AND y < yl THEN 1.0 ELSE 0 END) / 0.1, 6) AS lower FROM p JOIN q USING (a, b) GROUP BY 1, 2""", "rets", "sect")
def a58_tail_dependence(spark, d):
    return blocks.tail_dependence(_grouped(spark, d), *_IN_SECTOR, 0.1).select("a", "b", *r6("upper", "lower"))


_LEVELS = ", p AS (SELECT x.sector, x.date, x.entity AS a, y.entity AS b, ln(x.price) AS x, ln(y.price) AS y FROM (SELECT * FROM bars JOIN sect USING (entity)) x JOIN (SELECT * FROM bars JOIN sect USING (entity)) y ON x.sector = y.sector AND x.date = y.date AND x.entity < y.entity)"


_SURFACE = "CASE WHEN {t} <= -2.62 THEN 2.92::DOUBLE + 1.5012::DOUBLE * {t} + 0.039796::DOUBLE * {t} * {t} ELSE 2.1945::DOUBLE + 0.64695::DOUBLE * {t} - 0.29198::DOUBLE * {t} * {t} - 0.042377::DOUBLE * {t} * {t} * {t} END"
_UPPER = "0.3989422804014327::DOUBLE * exp(-z * z / 2) * k * (0.319381530::DOUBLE + k * (-0.356563782::DOUBLE + k * (1.781477937::DOUBLE + k * (-1.821255978::DOUBLE + k * 1.330274429::DOUBLE))))"


@query(_LEVELS + """, k AS (SELECT a, b, regr_slope(y, x) AS beta FROM p GROUP BY 1, 2), s AS (SELECT a, b, date, y - beta * x AS s FROM p JOIN k USING (a, b)), l AS (SELECT *, lag(s) OVER (PARTITION BY a, b ORDER BY date) AS l FROM s), h AS (SELECT a, b, regr_slope(s, l) AS rho, var_samp(l) AS vl, var_samp(s) AS vs, count(*) AS n FROM l WHERE l IS NOT NULL GROUP BY 1, 2),
 e AS (SELECT *, (rho - 1) / sqrt((vs - rho * rho * vl) / (vl * (n - 2))) AS t FROM h), w AS (SELECT *, """ + _SURFACE.format(t="t") + """ AS x FROM e), z AS (SELECT *, abs(x) AS z, 1 / (1 + 0.2316419::DOUBLE * abs(x)) AS k FROM w), u AS (SELECT *, CASE WHEN t <= -18.86 THEN 0 WHEN t >= 0.92 THEN 1 WHEN x <= 0 THEN """ + _UPPER + " ELSE 1 - " + _UPPER + """ END AS p FROM z)
 SELECT a, b, round(beta, 6) AS beta, round(rho, 6) AS rho, CASE WHEN rho > 0 AND rho < 1 THEN round(-ln(2) / ln(rho), 6) END AS half_life, round(p, 6) AS p_value FROM k JOIN u USING (a, b)""", "bars", "sect")
def a68_pair_regression(spark, d):
    b = bars(spark, d).join(sect(spark, d), "entity").withColumn("lp", F.log("price"))
    told = ("beta", "rho", "half_life", "p_value")
    return blocks.reversion(b, "entity", "date", "lp", ["sector"], dict.fromkeys(told, 6)).select("a", "b", *told)


_TAIL = "CASE WHEN c IS NOT NULL THEN 2 * 0.3989422804014327::DOUBLE * exp(-z * z / 2) * k * (0.319381530::DOUBLE + k * (-0.356563782::DOUBLE + k * (1.781477937::DOUBLE + k * (-1.821255978::DOUBLE + k * 1.330274429::DOUBLE)))) END"


@query(_PAIRS + f""", t AS (SELECT a, b, n, c, abs(c) * sqrt((n - 2) / (1 - c * c)) AS z FROM (SELECT a, b, count(*) AS n, corr(x, y) AS c FROM p GROUP BY 1, 2 HAVING count(*) >= 20)), v AS (SELECT a, b, round({_TAIL}, 9) AS p FROM (SELECT *, 1 / (1 + 0.2316419::DOUBLE * z) AS k FROM t) WHERE c IS NOT NULL),
 o AS (SELECT *, row_number() OVER (ORDER BY p, a, b) AS k, count(*) OVER () AS n FROM v), m AS (SELECT coalesce(max(k), 0) AS best FROM o WHERE p <= 0.1::DOUBLE * k / n) SELECT a, b, round(p, 6) AS p, k <= best AS survives FROM o, m""", "rets", "sect")
def a69_step_up_filter(spark, d):
    """p-values of the pairs' correlations, held against each other at a false discovery rate of 10 %."""
    return blocks.step_up_pairs(_grouped(spark, d), *_IN_SECTOR, 20, 0.1, 9, {"p": 6}).select("a", "b", "p", "survives")


@query(_PAIRS + ", c AS (SELECT a, b, abs(corr(x, y)) AS c FROM p GROUP BY 1, 2 HAVING count(*) >= 30), s AS (SELECT a AS target, b AS peer, c FROM c UNION ALL SELECT b, a, c FROM c) SELECT target, peer, round(c, 6) AS c FROM s QUALIFY row_number() OVER (PARTITION BY target ORDER BY c DESC, peer) <= 2 OR row_number() OVER (PARTITION BY target ORDER BY c, peer) <= 2", "rets", "sect")
def t05_peers_by_correlation(spark, d):
    s = blocks.extreme_peers(_grouped(spark, d), *_IN_SECTOR, 30, 2)  # four rows of a target for each block
    w = Window.partitionBy("target")
    s = s.withColumn("hi", F.row_number().over(w.orderBy(F.desc("c"), "peer"))).withColumn("lo", F.row_number().over(w.orderBy("c", "peer")))
    return s.where("hi <= 2 OR lo <= 2").select("target", "peer", *r6("c"))


@query(_ROLL + ", m AS (SELECT date, avg(c) AS m, stddev_samp(c) AS disp FROM rc GROUP BY 1) SELECT date, round(m, 6) AS mean_corr, round(disp, 6) AS dispersion, round((rank() OVER (ORDER BY m) - 1) / nullif(count(*) OVER () - 1, 0), 6) AS pctile FROM m WHERE m IS NOT NULL", "rets", "sect")
def w38_rolling_average_correlation(spark, d):
    # Sectors are blocks of one universe here: sums over sectors give the mean and deviation over all pairs.
    c = blocks.rolling_by_time(_grouped(spark, d), *_IN_SECTOR, [12]).where("n > 0")
    n, s, q = F.sum("n"), F.sum(F.col("n") * F.col("mean_corr")), F.sum(F.coalesce(F.col("std_corr") ** 2 * (F.col("n") - 1), F.lit(0.0)) + F.col("n") * F.col("mean_corr") ** 2)
    m = c.groupBy("date").agg((s / n).alias("mean_corr"), F.when(n > 1, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1))).alias("dispersion"))
    return m.withColumn("pctile", F.percent_rank().over(Window.orderBy("mean_corr"))).select("date", *r6("mean_corr", "dispersion", "pctile"))  # one row per date
