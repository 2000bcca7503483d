"""Alerts, evaluation windows, lots, text scores, recursions per entity and the batch forms of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import alerts, backtest, blocks, fundamentals, grouped, pairs, returns, spreads, windows
from tessera.plans.common import bars, fund, latest, query, r6, rets, sect
from tessera.registry import table
from tessera.scratch import cut
from tessera.streaming import panels

_B = ", b AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM bars)"


def _rules(spark, rows):
    return spark.createDataFrame([(i, t, "*", a, b, True, "high") for i, t, a, b in rows], "rule_id string, rule_type string, target string, p1 double, p2 double, enabled boolean, priority string")


@query(_B + " SELECT 'up' AS rule_id, entity, round(price, 6) AS value, 1450.0::DOUBLE AS threshold FROM b WHERE rn = 1 AND price > 1450 UNION ALL SELECT 'down', entity, round(price, 6), 1300.0 FROM b WHERE rn = 1 AND price < 1300", "bars")
def w29_price_alerts(spark, d):
    return alerts.evaluate(_rules(spark, [("up", "price_above", 1450.0, None), ("down", "price_below", 1300.0, None)]), bars(spark, d)).select("rule_id", "entity", *r6("value"), "threshold")


@query(_B + ", g AS (SELECT entity, (max(price) FILTER (rn = 1) / max(price) FILTER (rn = 4) - 1) * 100 AS v FROM b GROUP BY 1) SELECT 'p' AS rule_id, entity, round(v, 6) AS value, 5.0::DOUBLE AS threshold FROM g WHERE v >= 5", "bars")
def w30_change_alerts(spark, d):
    return alerts.evaluate(_rules(spark, [("p", "pct_above", 5.0, 3.0)]), bars(spark, d)).select("rule_id", "entity", *r6("value"), "threshold")


@query(_B + ", g AS (SELECT entity, max(price) FILTER (rn = 1) AS v, avg(price) AS t FROM b WHERE rn <= 12 GROUP BY 1 HAVING count(*) = 12) SELECT 's' AS rule_id, entity, round(v, 6) AS value, round(t, 6) AS threshold FROM g WHERE v > t", "bars")
def w31_average_alerts(spark, d):
    return alerts.evaluate(_rules(spark, [("s", "sma_above", 12.0, None)]), bars(spark, d)).select("rule_id", "entity", *r6("value", "threshold"))


@query(_B + ", g AS (SELECT entity, max(price) FILTER (rn = 1) AS v, max(price) FILTER (rn > 1) AS hi, min(price) FILTER (rn > 1) AS lo FROM b WHERE rn <= 12 GROUP BY 1 HAVING count(*) = 12) SELECT 'h' AS rule_id, entity, round(v, 6) AS value, round(hi, 6) AS threshold FROM g WHERE v >= hi UNION ALL SELECT 'l', entity, round(v, 6), round(lo, 6) FROM g WHERE v <= lo", "bars")
def w32_extreme_alerts(spark, d):
    return alerts.evaluate(_rules(spark, [("h", "new_high", 12.0, None), ("l", "new_low", 12.0, None)]), bars(spark, d)).select("rule_id", "entity", *r6("value", "threshold"))


@query(_B + ", g AS (SELECT entity, max(qty) FILTER (rn = 1) AS v, avg(qty) FILTER (rn > 1) AS t FROM b WHERE rn <= 7 GROUP BY 1 HAVING count(*) = 7) SELECT 'v' AS rule_id, entity, v AS value, round(0.3 * t, 6) AS threshold FROM g WHERE v >= 0.3 * t AND v > 0 AND t > 0", "bars")
def w33_volume_alerts(spark, d):
    return alerts.evaluate(_rules(spark, [("v", "volume_spike", 0.3, 6.0)]), bars(spark, d)).select("rule_id", "entity", "value", *r6("threshold"))


@query(" SELECT 'c1' AS rule_id, entity, 1.0::DOUBLE AS value FROM latest WHERE ev <= 9 AND pb <= 1.5 AND coalesce(roic >= 0.1, false) UNION ALL SELECT 'c2', entity, round((CAST(roe > 0.2 AS INTEGER) + CAST(de < 0.5 AS INTEGER)) / 2.0::DOUBLE, 6) FROM latest WHERE roe > 0.2 OR de < 0.5", "latest")
def w34_condition_alerts(spark, d):
    rules = spark.createDataFrame([("c1", "all", "ev<=9; pb<=1.5;roic>=0.1"), ("c2", "any", "roe>0.2;de<0.5")], "rule_id string, match string, conditions string")
    return alerts.conditions(rules, latest(spark, d), ["ev", "pb", "roic", "roe", "de"]).select("rule_id", "entity", *r6("value"))


@query(_B + ", g AS (SELECT entity, max(price) FILTER (rn = 1) AS v, avg(price) AS t, max(price) FILTER (rn > 1) AS hi FROM b WHERE rn <= 6 GROUP BY 1 HAVING count(*) = 6) SELECT 'a' AS rule_id, entity, round(v, 6) AS value, round(t, 6) AS threshold, TIMESTAMP '2000-01-01 00:00:00' AS run_at FROM g WHERE v < t UNION ALL SELECT 'b', entity, round(v, 6), round(hi, 6), TIMESTAMP '2000-01-01 00:00:00' FROM g WHERE v >= hi", "bars")
def w35_alert_run(spark, d):
    rules = _rules(spark, [("a", "sma_below", 6.0, None), ("b", "new_high", 6.0, None)]).unionByName(_rules(spark, [("off", "price_above", 0.0, None)]).withColumn("enabled", F.lit(False)))
    return alerts.run(rules, bars(spark, d), priority="high", at="2000-01-01 00:00:00").select("rule_id", "entity", *r6("value", "threshold"), "run_at")


@query(""", x AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY entity) AS n FROM bars), g AS (SELECT entity, max(n) AS n, min_by(price, date) AS a, max_by(price, date) AS z FROM x GROUP BY 1), h AS (SELECT *, unnest(generate_series(1, 7)) AS h FROM g)
 SELECT h.entity, CAST(h AS INTEGER) AS h, round(CASE WHEN h.n < 5 THEN z ELSE 0.6::DOUBLE * (z + (z - a) / (h.n - 1) * h) + 0.4::DOUBLE * x.price END, 6) AS forecast FROM h LEFT JOIN x ON x.entity = h.entity AND x.rn = 10 - h % 5""", "bars")
def w40_drift_forecast(spark, d):
    return backtest.drift_seasonal(bars(spark, d), "entity", "date", "price", list(range(1, 8))).select("entity", "h", *r6("forecast"))


@query(""", x AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS rn, count(*) OVER (PARTITION BY entity) AS n FROM bars), o AS (SELECT DISTINCT entity, unnest(generate_series(24, n - 3, 12)) AS origin FROM x WHERE n >= 27)
 SELECT entity, origin, round(avg(price) FILTER (rn <= origin), 6) AS context, round(avg(price) FILTER (rn > origin), 6) AS actual, round(avg(abs(price - (SELECT p.price FROM x p WHERE p.entity = q.entity AND p.rn = origin))) FILTER (rn > origin), 6) AS mae
 FROM (SELECT o.entity, CAST(origin AS BIGINT) AS origin, rn, price FROM o JOIN x ON x.entity = o.entity AND rn > origin - 24 AND rn <= origin + 3) q GROUP BY 1, 2""".replace("(SELECT p.price FROM x p WHERE p.entity = q.entity AND p.rn = origin)", "last").replace("SELECT o.entity, CAST(origin AS BIGINT) AS origin, rn, price FROM o", "SELECT o.entity, CAST(origin AS BIGINT) AS origin, rn, price, max(CASE WHEN rn = origin THEN price END) OVER (PARTITION BY o.entity, origin) AS last FROM o"), "bars")
def w41_rolling_origins(spark, d):
    o = backtest.origins(bars(spark, d).select("entity", "date", "price"), "entity", "date", 24, 3, 12)
    o = o.withColumn("last", F.max(F.when(F.col("offset") == 0, F.col("price"))).over(Window.partitionBy("entity", "origin")))
    ahead = lambda c: F.when(F.col("offset") > 0, c)
    return o.groupBy("entity", F.col("origin").cast("long").alias("origin")).agg(F.round(F.avg(F.when(F.col("offset") <= 0, F.col("price"))), 6).alias("context"), F.round(F.avg(ahead(F.col("price"))), 6).alias("actual"), F.round(F.avg(ahead(F.abs(F.col("price") - F.col("last")))), 6).alias("mae"))


@query(""", x AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS rn, count(*) OVER (PARTITION BY entity) AS n FROM bars), w AS (SELECT entity, date, CAST((rn - 1) // 12 AS INTEGER) AS "window", n // 12 AS k FROM x) SELECT entity, date, "window", CASE WHEN "window" < floor(k * 0.7) THEN 'train' ELSE 'test' END AS part FROM w WHERE "window" < k""", "bars")
def w43_split_windows(spark, d):
    return backtest.split_windows(bars(spark, d), "entity", "date", 12, 0.7).select("entity", "date", "window", "part")


@query(""", x AS (SELECT entity, date, row_number() OVER (PARTITION BY entity ORDER BY date) AS rn, count(*) OVER (PARTITION BY entity) AS n FROM bars), f AS (SELECT *, unnest([0, 1, 2, 3]) AS fold FROM x), b AS (SELECT *, fold * n // 4 + 1 AS lo, (fold + 1) * n // 4 AS hi FROM f)
 SELECT entity, date, fold, CASE WHEN rn BETWEEN lo AND hi THEN 'test' WHEN rn < lo - 2 OR rn > hi + 2 THEN 'train' ELSE 'purged' END AS part FROM b""", "bars")
def w44_purged_folds(spark, d):
    """All four folds of every series, however short."""
    return backtest.purged_folds(bars(spark, d), "entity", "date", 4, 2, 0, 0).select("entity", "date", "fold", "part")


@query(""", s AS (SELECT b.entity, sector, date, price FROM bars b JOIN sect USING (entity)), px AS (SELECT sector, date, avg(price) AS p FROM s GROUP BY 1, 2), f AS (SELECT entity, sector, min(date) AS fd, min_by(price, date) AS v, count(*) AS n FROM s GROUP BY 1, 2),
 e AS (SELECT f.entity, f.sector, px.date, px.p * v / p0.p AS price, row_number() OVER (PARTITION BY f.entity ORDER BY px.date DESC) AS k, n FROM f JOIN px p0 ON p0.sector = f.sector AND p0.date = fd JOIN px ON px.sector = f.sector AND px.date < fd WHERE n < 84)
 SELECT entity, date, round(price, 6) AS price, false AS padded FROM s UNION ALL SELECT entity, date, round(price, 6), true FROM e WHERE k <= 84 - n""", "bars", "sect")
def w46_padded_context(spark, d):
    """All bars; series that are short in the table are padded."""
    b = bars(spark, d).join(sect(spark, d).select("entity", "sector"), "entity")
    proxy = b.groupBy("sector", "date").agg(F.avg("price").alias("price"))
    return backtest.pad_context(b.select("entity", "sector", "date", "price"), proxy, "entity", "sector", "date", "price", 84).select("entity", "date", *r6("price"), "padded")


_LEDGER = "t AS (SELECT l_partkey AS entity, CAST(l_shipdate AS DATE) AS dt, concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS seq, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS q, l_extendedprice / l_quantity / 1.07::DOUBLE AS p FROM lineitem)"


@query(f"""WITH {_LEDGER}, c AS (SELECT *, sum(abs(q)) OVER (PARTITION BY entity, q > 0 ORDER BY dt, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM t), b AS (SELECT *, e - q AS s FROM c WHERE q > 0), k AS (SELECT *, e + q AS s FROM c WHERE q < 0)
 SELECT b.entity, b.seq AS buy, k.seq AS sell, least(b.e, k.e) - greatest(b.s, k.s) AS qty, round((least(b.e, k.e) - greatest(b.s, k.s)) * (k.p - b.p), 4) AS pl FROM b JOIN k ON b.entity = k.entity AND b.s < k.e AND k.s < b.e""")
def a85_lot_matching(spark, d):
    """The whole ledger."""
    seq = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    t = table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_shipdate").cast("date").alias("dt"), seq.alias("seq"), F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("q"), (F.col("l_extendedprice") / F.col("l_quantity") / 1.07).alias("p"))
    return backtest.match_lots(t, "entity", "dt", "seq", "q", "p").withColumn("pl", F.round("pl", 4))


@query(""", x AS (SELECT *, price / max(price) OVER (PARTITION BY entity ORDER BY date) - 1 AS dd, price / lag(price) OVER (PARTITION BY entity ORDER BY date) - 1 AS r FROM bars), y AS (SELECT *, CASE WHEN count(r) OVER w >= 6 THEN stddev_samp(r) OVER w END AS vol FROM x WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
 z AS (SELECT *, coalesce(dd < -0.5 OR vol > 0.6, dd < -0.5) AS breach FROM y) SELECT entity, date, round(dd, 6) AS dd, breach, min(CASE WHEN breach THEN date END) OVER (PARTITION BY entity) AS first_breach FROM z""", "bars")
def a86_equity_flags(spark, d):
    return backtest.equity_flags(bars(spark, d), "entity", "date", "price", 0.5, 0.6, 6).select("entity", "date", *r6("dd"), "breach", "first_breach")


@query("""WITH x AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g')), '[a-z]+') AS w FROM documents), l AS (SELECT word, CASE WHEN len(word) % 2 = 0 THEN 1 ELSE -1 END AS weight FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)),
 t AS (SELECT doc_id, unnest(w) AS word FROM x), h AS (SELECT doc_id, count(*) FILTER (weight > 0) AS p, count(*) FILTER (weight < 0) AS n FROM t JOIN l USING (word) GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS words, coalesce(p, 0) AS positive, coalesce(n, 0) AS negative, round(coalesce(1000.0::DOUBLE * (coalesce(p, 0) - coalesce(n, 0)) / nullif(len(w), 0), 0), 6) AS score FROM x LEFT JOIN h USING (doc_id)""")
def a84_lexicon_score(spark, d):
    """A lexicon of the benchmark's words: those of even length count for, the others against."""
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).distinct()
    lexicon = words.withColumn("weight", F.when(F.length("word") % 2 == 0, 1).otherwise(-1))
    s = backtest.lexicon_scores(table(spark, d, "documents"), "doc_id", "text", lexicon)
    return s.select("doc_id", "words", "positive", "negative", *r6("score"))


@query("""WITH c AS (SELECT o_custkey AS entity, CASE WHEN l_returnflag = 'A' THEN 'put' ELSE 'call' END AS side, l_extendedprice / l_quantity / 15 AS strike, l_discount + l_tax AS iv, l_quantity AS volume, 100.0::DOUBLE AS spot FROM lineitem JOIN orders ON l_orderkey = o_orderkey), k AS (SELECT * FROM c WHERE iv > 0.05::DOUBLE),
 g AS (SELECT entity, count(*) FILTER (side = 'call') AS calls, median(iv) FILTER (side = 'call' AND abs(strike - spot) / spot <= 0.05::DOUBLE) AS atm, coalesce(sum(volume) FILTER (side = 'put'), 0) AS p, coalesce(sum(volume) FILTER (side = 'call'), 0) AS v,
 arg_min(iv, (abs(strike - 0.9::DOUBLE * spot), strike, iv)) FILTER (side = 'call') - arg_min(iv, (abs(strike - 1.1::DOUBLE * spot), strike, iv)) FILTER (side = 'call') AS skew FROM k GROUP BY 1)
 SELECT entity, CASE WHEN atm > 0.05 AND atm < 3 THEN round(atm, 6) END AS atm, CASE WHEN v > 0 THEN round(p / v, 6) END AS put_call, round(skew, 6) + 0.0 AS skew FROM g WHERE calls > 0""")
def a83_option_measures(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("entity")), "l_orderkey")
    c = li.select("entity", F.when(F.col("l_returnflag") == "A", "put").otherwise("call").alias("side"), (F.col("l_extendedprice") / F.col("l_quantity") / 15).alias("strike"), (F.col("l_discount") + F.col("l_tax")).alias("iv"), F.col("l_quantity").alias("volume"), F.lit(100.0).alias("spot"))
    return backtest.option_measures(c, ["entity"], "side", "strike", "iv", "volume", "spot").select("entity", *r6("atm", "put_call"), (F.round("skew", 6) + 0.0).alias("skew"))


@query("""WITH e AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS name, 'order' AS kind FROM orders UNION SELECT DISTINCT CAST(ts AS DATE), event_type, 'event' FROM events), t AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)
 SELECT e.date, name, kind, t.date IS NOT NULL AS trading, CAST(e.date - DATE '2000-01-01' AS INTEGER) AS days_until FROM e LEFT JOIN t ON e.date = t.date""")
def a82_event_calendar(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("name"))
    e = table(spark, d, "events").select(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("name"))
    days = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    return backtest.event_calendar([("order", o), ("event", e)], days, "2000-01-01").select("date", "name", "kind", "trading", "days_until")


@query(" SELECT entity, as_of, CASE WHEN count(*) OVER f = 4 THEN round(sum(amount) OVER f, 2) END AS ttm, CASE WHEN count(*) OVER e = 8 THEN round(abs(avg(amount) OVER e) / stddev_pop(amount) OVER e, 6) END AS stability FROM fund WINDOW f AS (PARTITION BY entity ORDER BY as_of ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), e AS (PARTITION BY entity ORDER BY as_of ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)", "fund")
def p33_trailing_year(spark, d):
    return fundamentals.trailing_year(fund(spark, d), "entity", "as_of", "amount").select("entity", "as_of", F.round("ttm", 2).alias("ttm"), *r6("stability"))


@query(""", t AS (SELECT entity, as_of, CASE WHEN count(*) OVER f = 4 THEN sum(amount) OVER f END AS ttm FROM fund WINDOW f AS (PARTITION BY entity ORDER BY as_of ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)), q AS (SELECT DISTINCT o_custkey AS entity, CAST(date_trunc('year', o_orderdate) AS DATE) AS t FROM orders)
 SELECT q.entity, q.t, round(ttm, 2) AS ttm FROM q ASOF LEFT JOIN (SELECT * FROM t WHERE ttm IS NOT NULL) t ON q.entity = t.entity AND q.t >= t.as_of""", "fund")
def w26_trailing_asof(spark, d):
    from tessera.operators.asof import asof

    t = fundamentals.trailing_year(fund(spark, d), "entity", "as_of", "amount").where("ttm IS NOT NULL")
    q = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.date_trunc("year", "o_orderdate").cast("date").alias("t")).distinct()
    return asof(q, t, "t", "as_of", ["ttm"], ["entity"]).select("entity", "t", F.round("ttm", 2).alias("ttm"))


@query(" SELECT entity, as_of, round(100 * (amount - lag(amount) OVER w) / abs(lag(amount) OVER w), 6) AS revision FROM fund WINDOW w AS (PARTITION BY entity ORDER BY as_of)", "fund")
def w25_revisions(spark, d):
    return fundamentals.revisions(fund(spark, d), ["entity"], "as_of", "amount").select("entity", "as_of", *r6("revision"))


#: Exponential averages as recursions over each entity's numbered rows.
_EMA = """, n AS (SELECT entity, date, price, row_number() OVER w AS k, price - lag(price) OVER w AS step FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)),
 rec AS (SELECT entity, date, k, price AS f, price AS s, 0.0::DOUBLE AS g, CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS down FROM n WHERE k = 1
  UNION ALL SELECT n.entity, n.date, n.k, f + (n.price - f) * 2 / 13, s + (n.price - s) * 2 / 27, g + (f + (n.price - f) * 2 / 13 - s - (n.price - s) * 2 / 27 - g) / 5, coalesce(up + (greatest(n.step, 0) - up) / 14, greatest(n.step, 0)), coalesce(down + (greatest(-n.step, 0) - down) / 14, greatest(-n.step, 0)) FROM rec JOIN n ON n.entity = rec.entity AND n.k = rec.k + 1),
 mv AS (SELECT entity, date, price, CASE WHEN k >= 20 THEN avg(price) OVER s END AS near, CASE WHEN k >= 20 THEN stddev_samp(price) OVER s END AS sd, CASE WHEN k >= 50 THEN avg(price) OVER l END AS far FROM n
  WINDOW s AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), l AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
 cr AS (SELECT *, near - far AS gap, lag(near - far) OVER (PARTITION BY entity ORDER BY date) AS was FROM mv)"""


@query(_EMA + """ SELECT entity, date, CASE WHEN k > 14 THEN round(CASE WHEN down <> 0 THEN 100 - 100 / (1 + up / down) END, 5) END AS rsi, round(f - s, 5) AS macd, round(g, 5) AS macd_signal, round(f - s - g, 5) AS macd_hist, round(near + 2 * sd, 5) AS bb_upper, round(near - 2 * sd, 5) AS bb_lower,
 CASE WHEN sd > 0 THEN round((price - (near - 2 * sd)) / (4 * sd), 5) END AS bollinger, round(near, 5) AS sma_short, round(far, 5) AS sma_long, CASE WHEN gap > 0 AND was <= 0 THEN 1 WHEN gap < 0 AND was >= 0 THEN -1 ELSE 0 END AS sma_cross, date = max(date) OVER (PARTITION BY entity) AS newest FROM rec JOIN cr USING (entity, date)""", "bars")
def w15_indicators(spark, d):
    """All rows; ``newest`` marks each entity's last one, the report of the current state."""
    out = grouped.indicators(bars(spark, d), "entity", "date", "price")
    names = ("rsi", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "bollinger", "sma_short", "sma_long")
    return out.select("entity", "date", *[F.round(c, 5).alias(c) for c in names], "sma_cross", (F.col("date") == F.max("date").over(Window.partitionBy("entity"))).alias("newest"))


@query(""", n AS (SELECT entity, date, row_number() OVER w AS k, greatest(high - low, abs(high - lag(price) OVER w), abs(low - lag(price) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)),
 rec AS (SELECT entity, date, k, tr AS atr FROM n WHERE k = 1 UNION ALL SELECT n.entity, n.date, n.k, atr + (n.tr - atr) / 14 FROM rec JOIN n ON n.entity = rec.entity AND n.k = rec.k + 1) SELECT entity, date, CASE WHEN k >= 14 THEN round(atr, 5) END AS atr FROM rec""", "bars")
def w16_average_true_range(spark, d):
    return grouped.average_true_range(windows.true_range(bars(spark, d), "entity", "date", "high", "low", "price"), "entity", "date", "tr").select("entity", "date", F.round("atr", 5).alias("atr"))


#: A filter step: the variance p widens by q; a value moves the level m by the gain and lowers p.
_STEP = "SELECT n.entity, n.date, n.k, CASE WHEN {seen} THEN m + (p + 1e-5) / (p + 1e-5 + 1e-3) * (n.r - m) ELSE m END AS m, CASE WHEN {seen} THEN (p + 1e-5) * (1 - (p + 1e-5) / (p + 1e-5 + 1e-3)) ELSE p + 1e-5 END AS p, CASE WHEN {seen} THEN (p + 1e-5) / (p + 1e-5 + 1e-3) END AS gain, CASE WHEN {seen} THEN n.r - m END AS innovation"


@query(", n AS (SELECT entity, date, r, row_number() OVER (PARTITION BY entity ORDER BY date) AS k FROM rets), rec AS (" + _STEP.format(seen="n.r IS NOT NULL") + " FROM n JOIN (SELECT 0.0::DOUBLE AS m, 1.0::DOUBLE AS p) ON n.k = 1 UNION ALL " + _STEP.format(seen="n.r IS NOT NULL") + " FROM rec JOIN n ON n.entity = rec.entity AND n.k = rec.k + 1) SELECT entity, date, round(m, 6) AS level, round(gain, 6) AS gain, round(innovation, 6) AS innovation FROM rec", "rets")
def w36_local_level_filter(spark, d):
    return grouped.kalman(rets(spark, d), ["entity"], "date", "r").select("entity", "date", *r6("level", "gain", "innovation"))


@query(", n AS (SELECT entity, date, CASE WHEN lag(price, 3) OVER (PARTITION BY entity ORDER BY date) IS NOT NULL THEN r END AS r, row_number() OVER (PARTITION BY entity ORDER BY date) AS k FROM rets), rec AS (" + _STEP.format(seen="n.r IS NOT NULL") + " FROM n JOIN (SELECT 0.0::DOUBLE AS m, 1.0::DOUBLE AS p) ON n.k = 1 UNION ALL " + _STEP.format(seen="n.r IS NOT NULL") + " FROM rec JOIN n ON n.entity = rec.entity AND n.k = rec.k + 1) SELECT entity, date, round(m, 6) AS level_x, round(gain, 6) AS gain, round(innovation, 6) AS innovation_x FROM rec", "rets")
def w36_two_level_filter(spark, d):
    """The two-dimensional form, over returns of one and of three rows: a row where either is missing, as in the first three, moves neither level."""
    x = returns.horizon(rets(spark, d), "entity", "date", "price", 3, "y")
    return grouped.kalman_two(x, ["entity"], "date", "r", "y").select("entity", "date", *r6("level_x", "gain", "innovation_x"))


def _in_sectors(spark, d):
    return rets(spark, d).join(sect(spark, d).select("entity", "sector"), "entity"), "entity", "date", "r", ["sector"]


_FILTER = "SELECT n.a, n.b, n.date, n.k, CASE WHEN n.k > 5 THEN m + (p + 1e-4) / (p + 1e-4 + 0.05) * (n.z - m) ELSE m END AS m, CASE WHEN n.k > 5 THEN (p + 1e-4) * (1 - (p + 1e-4) / (p + 1e-4 + 0.05)) ELSE p END AS p"


@query(""", pq AS (SELECT x.date, x.entity AS a, y.entity AS b, x.r AS x, y.r AS y FROM (SELECT * FROM rets JOIN sect USING (entity) WHERE r IS NOT NULL) x JOIN (SELECT * FROM rets JOIN sect USING (entity) WHERE r IS NOT NULL) y ON x.sector = y.sector AND x.date = y.date AND x.entity < y.entity),
 n AS (SELECT a, b, date, row_number() OVER (PARTITION BY a, b ORDER BY date) AS k, least(greatest(x * y / ((stddev_pop(x) OVER w + 1e-12::DOUBLE) * (stddev_pop(y) OVER w + 1e-12::DOUBLE)), -3), 3) AS z FROM pq WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 rec AS (""" + _FILTER + " FROM n JOIN (SELECT 0.0::DOUBLE AS m, 1.0::DOUBLE AS p) ON n.k = 1 UNION ALL " + _FILTER + " FROM rec JOIN n ON n.a = rec.a AND n.b = rec.b AND n.k = rec.k + 1) SELECT a, b, date, CASE WHEN k > 5 THEN round(least(greatest(m, -1), 1), 6) END AS corr FROM rec", "rets", "sect")
def w37_filtered_correlation(spark, d):
    return blocks.filtered_correlation(*_in_sectors(spark, d), digits={"corr": 6}).select("a", "b", "date", "corr")


@query()
def a81_lead_lag(spark, d):
    return blocks.lead_lag(*_in_sectors(spark, d), digits={"f": 6}).select("a", "b", "n", "f")


def _spreads(spark, d):
    """Logarithms of prices inside sectors, walk-forward folds of their dates and the trade rule."""
    b = bars(spark, d).join(sect(spark, d).select("entity", "sector"), "entity").withColumn("lp", F.log("price"))
    folds = backtest.fold_dates(b, "date", folds=2, lookback=36, test=18)
    return b, "entity", "date", "lp", ["sector"], folds, spreads.Rule(least=20, entry=1.5, hold=12)


@query()
def w47_pair_trades(spark, d):
    t = spreads.trades(*_spreads(spark, d), digits=dict.fromkeys(("entry_z", "exit_z", "pnl", "hedged_pnl"), 6))
    return t.select("fold", "a", "b", "entry_date", "exit_date", "entry_z", "exit_z", "bars_held", "reason", "pnl", "hedged_pnl")


@query()
def w48_walk_forward_pairs(spark, d):
    """In each fold, pairs whose spread reverts on the training dates (step-up filter over p-values of the unit-root statistic, half-life from 0.5 to 24 rows) are traded on the test dates, net of costs."""
    t = spreads.walk_forward(*_spreads(spark, d), 0.2, (0.5, 24.0), 10.0 / 10000, 25.0 / 10000, digits={"win_rate": 6, "net": 6})
    return t.select("a", "b", "trades", "folds", "win_rate", "net")


@query()
def a70_pair_summary(spark, d):
    told = ("win_rate", "mean", "total", "sharpe")
    return spreads.summary(*_spreads(spark, d), digits=dict.fromkeys(told, 6)).select("a", "b", "trades", *told)


@query("SELECT user_id, date_trunc('day', ts) AS start, max_by(value, ts) AS price, round(sum(value), 4) AS qty, count(*) AS n FROM events GROUP BY 1, 2")
def r03_daily_bars(spark, d):
    return panels.bars(table(spark, d, "events"), "user_id", "ts", "value", "value").select("user_id", "start", "price", F.round("qty", 4).alias("qty"), "n")


@query("""WITH e AS (SELECT user_id, ts FROM events WHERE event_type = 'error'), x AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM x)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM y GROUP BY user_id, k""")
def r04_error_sessions(spark, d):
    return panels.spells(table(spark, d, "events").where("event_type = 'error'"), "user_id", "ts")


@query("WITH x AS (SELECT user_id AS entity, ts, value AS price FROM events) SELECT 'hi' AS rule_id, entity, ts, price FROM x WHERE price > 200 UNION ALL SELECT 'lo', entity, ts, price FROM x WHERE price < 0.5")
def r02_level_alerts(spark, d):
    rules = spark.createDataFrame([("hi", "*", "above", 200.0), ("lo", "*", "below", 0.5)], "rule_id string, target string, side string, level double")
    x = table(spark, d, "events").select(F.col("user_id").alias("entity"), "ts", F.col("value").alias("price"))
    return panels.level_alerts(x, rules).select("rule_id", "entity", "ts", "price")


