"""Sources, merges, cleaning, set operations, top-N and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import clean
from tessera.plans.common import bars, fund, query, r6, rets, sect
from tessera.registry import table
from tessera.sources import tables as src


@query("SELECT l_suppkey, l_shipdate, l_extendedprice FROM lineitem WHERE l_suppkey IN (1, 3, 5, 7)")
def s01_column_and_entity_scan(spark, d):
    return src.scan(spark, f"{d}/lineitem.parquet", ["l_suppkey", "l_shipdate", "l_extendedprice"], "l_suppkey", [1, 3, 5, 7])


@query("SELECT o_orderkey, upper(o_orderpriority) AS priority, CAST(o_orderdate AS DATE) AS date FROM orders")
def s02_source_preference(spark, d):
    o = src.prefer(spark, f"{d}/orders_clean.parquet", f"{d}/orders.parquet")
    return o.select("o_orderkey", F.upper("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("date").alias("date"))


@query("SELECT l_suppkey AS entity, l_extendedprice * (1 - l_discount) AS close FROM lineitem")
def s03_adjusted_scan(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_extendedprice").alias("close"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("adj"))
    return src.adjusted(li, "close", "adj")


_TWICE = "x AS (SELECT o_custkey AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, o_totalprice AS v, o_orderkey AS seq, o_orderstatus AS src FROM orders)"


def _twice(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("k"), F.date_trunc("month", "o_orderdate").cast("date").alias("m"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("src"))


@query(f"WITH {_TWICE} SELECT k, m, v, seq, src FROM x QUALIFY row_number() OVER (PARTITION BY k, m ORDER BY seq DESC) = 1")
def s05_append_last_wins(spark, d):
    x = _twice(spark, d)
    return src.append_last_wins(x.where("src = 'F'"), x.where("src <> 'F'"), ["k", "m"])


@query(f"WITH {_TWICE} SELECT k, m, round(avg(v), 4) AS v, min(src) AS src, count(DISTINCT v) > 1 AS conflict FROM x GROUP BY 1, 2")
def s06_resolve_conflicts(spark, d):
    return src.resolve_conflicts(_twice(spark, d), ["k", "m"], ["v"], "src").withColumn("v", F.round("v", 4))


@query(f"WITH {_TWICE} SELECT * FROM x WHERE src <> 'F' AND (k, m) NOT IN (SELECT (k, m) FROM x WHERE src = 'F') UNION ALL SELECT * FROM x WHERE src = 'F'")
def s07_overwrite_upsert(spark, d):
    x = _twice(spark, d)
    return src.upsert(x.where("src <> 'F'"), x.where("src = 'F'"), ["k", "m"])


@query("""WITH old AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_extendedprice) AS v FROM lineitem GROUP BY ALL), new AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY ALL)
 SELECT l_suppkey AS entity, round(max(abs(new.v / old.v - 1)), 6) AS shift FROM old JOIN new USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) GROUP BY 1 HAVING max(abs(new.v / old.v - 1)) > 0.01""")
def s08_rescale_detection(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("entity"), F.col("l_extendedprice").alias("v"), "l_discount")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "entity"]
    one = lambda x: x.groupBy(*keys).agg(F.max("v").alias("v"))  # noqa: E731 - a repeated line key is one value
    new = li.withColumn("v", F.col("v") * (1 - F.col("l_discount")))
    return src.rescaled(one(li), one(new), keys, "entity", "v", 0.01).withColumn("shift", F.round("shift", 6))


@query("SELECT doc_id AS entity FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def s10_coverage_gap(spark, d):
    """Documents that no label covers."""
    members = table(spark, d, "documents").select(F.col("doc_id").alias("entity"))
    return src.uncovered(members, table(spark, d, "labels").select(F.col("doc_id").alias("entity")), "entity")


@query("SELECT '{\"o_orderkey\":' || o_orderkey || ',\"date\":\"' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '\",\"flag\":' || CASE WHEN o_totalprice > 250000 THEN 'null' ELSE '1.5' END || '}' AS record FROM orders")
def s12_json_records(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"), F.when(F.col("o_totalprice") > 250000, F.lit(float("nan"))).otherwise(F.lit(1.5)).alias("flag"))
    return src.records(o)


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 60")
def s13_recent_tail(spark, d):
    return src.recent(table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date")), "date", 60)


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 60 ORDER BY date DESC, o_orderkey LIMIT 40")
def s13_recent_tail_capped(spark, d):
    """The export with its row cap: the newest 40 rows."""
    return src.recent(table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date")), "date", 60, 40)


@query("""SELECT 'lineitem' AS name, '' AS missing, count(*) AS rows, count(*) FILTER (l_orderkey IS NULL OR l_shipdate IS NULL) AS incomplete, count(*) > 0 AND count(*) FILTER (l_orderkey IS NULL OR l_shipdate IS NULL) = 0 AS ok FROM lineitem
 UNION ALL SELECT 'orders', 'o_channel', count(*), count(*) FILTER (o_orderkey IS NULL), false FROM orders""")
def s14_schema_contract(spark, d):
    return src.contract({n: table(spark, d, n) for n in ("lineitem", "orders")}, {"lineitem": ["l_orderkey", "l_shipdate"], "orders": ["o_orderkey", "o_channel"]})


@query("""SELECT entity, taxonomy, tag, unit, frame_end AS "end", val, filed FROM (SELECT o_custkey AS entity, CASE WHEN o_orderkey % 3 = 0 THEN 'house' ELSE 'trade' END AS taxonomy, o_orderpriority AS tag, CASE WHEN o_totalprice < 200000 THEN 'USD' ELSE 'shares' END AS unit, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS frame_end, o_totalprice AS val, CAST(o_orderdate AS DATE) AS filed FROM orders WHERE o_orderstatus <> 'P')
 QUALIFY row_number() OVER (PARTITION BY entity, taxonomy, tag, unit, frame_end ORDER BY filed DESC, val DESC) = 1""")
def s15_nested_facts(spark, d):
    """One JSON text per customer, built of the orders, taken apart again: taxonomies, tags and units as they come."""
    o = table(spark, d, "orders")
    q = F.date_trunc("quarter", "o_orderdate").cast("date")
    frame = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("CY"), F.year("o_orderdate"))).otherwise(F.concat(F.lit("CY"), F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")))
    entry = F.struct(q.alias("end"), F.col("o_totalprice").alias("val"), frame.alias("frame"), F.col("o_orderdate").cast("date").alias("filed"))
    taxonomy = F.when(F.col("o_orderkey") % 3 == 0, "house").otherwise("trade")
    unit = F.when(F.col("o_totalprice") < 200000, "USD").otherwise("shares")
    nest = lambda df, keys, name, held: df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(name, held))).alias("m"))
    units = o.groupBy(F.col("o_custkey").alias("entity"), taxonomy.alias("taxonomy"), F.col("o_orderpriority").alias("tag"), unit.alias("unit")).agg(F.collect_list(entry).alias("m"))  # one customer's filings
    tags = nest(units, ["entity", "taxonomy", "tag"], "unit", "m").withColumn("m", F.struct(F.col("m").alias("units")))
    text = nest(nest(tags, ["entity", "taxonomy"], "tag", "m"), ["entity"], "taxonomy", "m").select("entity", F.to_json(F.struct(F.col("m").alias("facts"))).alias("json"))
    return src.single_quarters(src.fact_rows(text, "entity", "json")).select("entity", "taxonomy", "tag", "unit", "end", "val", "filed")


@query("SELECT CAST(c_custkey AS BIGINT) AS entity, CASE WHEN o.n > 12 THEN 'busy' ELSE c_mktsegment END AS segment, c_acctbal AS bal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def s16_patch_dimension(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("bal"))
    change = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).count().where("count > 12").select("entity", F.lit("busy").alias("segment"))
    return src.patch(base, change, "entity", ["segment"])


@query("SELECT entity, date, round(r, 6) AS ret FROM rets WHERE abs(r) > 0.35", "rets")
def p01_price_jumps(spark, d):
    return clean.price_jumps(bars(spark, d), "entity", "date", "price", 0.35).select("entity", "date", *r6("ret"))


@query(""", a AS (SELECT entity, date, last_value(CASE WHEN price >= 1000 THEN price END IGNORE NULLS) OVER w AS p, last_value(CASE WHEN qty > 100 THEN qty END IGNORE NULLS) OVER w AS q FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 b AS (SELECT *, p / lag(p) OVER (PARTITION BY entity ORDER BY date) - 1 AS step FROM a)
 SELECT entity, date, round(last_value(CASE WHEN coalesce(abs(step) <= 0.25, true) THEN p END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS price, q AS qty FROM b""", "bars")
def p02_clean_prices(spark, d):
    b = bars(spark, d).withColumn("qty", F.when(F.col("qty") > 100, F.col("qty")).otherwise(0.0))
    return clean.clean_prices(b, "entity", "date", "price", "qty", 0.25, 1000).select("entity", "date", *r6("price"), "qty")


@query(f"WITH {_TWICE} SELECT k, m, v FROM x QUALIFY row_number() OVER (PARTITION BY k, m ORDER BY seq DESC) = 1")
def p03_pit_dedupe(spark, d):
    return clean.pit_dedupe(_twice(spark, d), ["k", "m"], "seq").select("k", "m", "v")


@query(""", x AS (SELECT entity, date, high / lag(high) OVER (PARTITION BY entity ORDER BY date) AS ratio FROM bars),
 y AS (SELECT *, CASE WHEN abs(ratio / 0.5 - 1) <= 0.03 THEN 0.5::DOUBLE WHEN abs(ratio / 2 - 1) <= 0.03 THEN 2 WHEN abs(ratio * 3 - 1) <= 0.03 THEN 1 / 3.0 WHEN abs(ratio / 3 - 1) <= 0.03 THEN 3 WHEN abs(ratio * 4 - 1) <= 0.03 THEN 0.25
  WHEN abs(ratio / 4 - 1) <= 0.03 THEN 4 WHEN abs(ratio * 5 - 1) <= 0.03 THEN 0.2 WHEN abs(ratio / 5 - 1) <= 0.03 THEN 5 END AS split FROM x) SELECT entity, date, round(ratio, 6) AS ratio, round(split, 6) AS split FROM y WHERE split IS NOT NULL""", "bars")
def p04_suspected_splits(spark, d):
    return clean.suspected_splits(bars(spark, d), "entity", "date", "high").select("entity", "date", *r6("ratio", "split"))


@query(""", x AS (SELECT entity, date, high / lag(high) OVER (PARTITION BY entity ORDER BY date) AS q FROM bars), y AS (SELECT q, list_bool_or(list_transform([0.5, 2.0, 1 / 3.0, 3.0, 0.25, 4.0, 0.2, 5.0], lambda t : abs(q - t) / t < 0.03)) AS split FROM x WHERE q IS NOT NULL)
 SELECT count(*) AS n, round(avg(CASE WHEN abs(q - 1) > 0.1 THEN 1.0 ELSE 0 END), 6) AS over_10, round(avg(CASE WHEN abs(q - 1) > 0.25 THEN 1.0 ELSE 0 END), 6) AS over_25, round(avg(CASE WHEN abs(q - 1) > 0.35 THEN 1.0 ELSE 0 END), 6) AS over_35, count(*) FILTER (split) AS splits FROM y""", "bars")
def p04_jump_summary(spark, d):
    return clean.jump_summary(bars(spark, d), "entity", "date", "high").select("n", *r6("over_10", "over_25", "over_35"), "splits")


@query(""", x AS (SELECT entity, date, price, CASE WHEN floor(price / 1000) = lag(floor(price / 1000)) OVER (PARTITION BY entity ORDER BY date) THEN 0 ELSE 1 END AS chg FROM bars), y AS (SELECT *, sum(chg) OVER (PARTITION BY entity ORDER BY date) AS isl FROM x),
 z AS (SELECT entity, isl, count(*) AS n FROM y GROUP BY 1, 2) SELECT entity, max(n) AS longest FROM z GROUP BY 1 HAVING max(n) >= 3""", "bars")
def p05_flat_runs(spark, d):
    b = bars(spark, d).withColumn("band", F.floor(F.col("price") / 1000))
    return clean.flat_runs(b, "entity", "date", "band", 3).select("entity", "longest")


@query(" UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS n, count(*) FILTER ({f} IS NULL) AS missing, count(*) FILTER ({f} <= 0) AS non_positive, round(count(*) FILTER ({f} IS NULL) / count(*), 6) AS share FROM fund" for f in ("roe", "roic", "de", "ev")), "fund")
def p06_missingness(spark, d):
    return clean.missingness(fund(spark, d), ["roe", "roic", "de", "ev"]).withColumn("share", F.round("share", 6))


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT user_id AS k FROM events) SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (k)) AS n_both, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_b")
def p07_key_coverage(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("in_a", F.lit(True))
    b = table(spark, d, "events").select(F.col("user_id").alias("k")).distinct().withColumn("in_b", F.lit(True))
    return a.join(b, "k", "full_outer").agg(F.count_if("in_a").alias("n_a"), F.count_if("in_b").alias("n_b"), F.count_if(F.col("in_a") & F.col("in_b")).alias("n_both"), F.count_if(F.col("in_b") & F.col("in_a").isNull()).alias("only_b"))


@query(""", x AS (SELECT entity, date, price, abs(ln(price / lag(price) OVER w)) AS a, abs(ln(lead(price) OVER w / price)) AS b FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)) SELECT entity, date, round(avg(price), 6) AS price FROM x WHERE coalesce(a <= 0.2, true) AND coalesce(b <= 0.2, true) GROUP BY 1, 2""", "bars")
def p08_two_sided_drop(spark, d):
    return clean.two_sided_drop(bars(spark, d), "entity", "date", "price", 0.2).select("entity", "date", *r6("price"))


@query("SELECT l_suppkey AS entity, round(avg(abs((1 - l_discount) - 1)), 4) AS gap FROM lineitem GROUP BY 1 HAVING avg(abs((1 - l_discount) - 1)) < 0.05037")
def p09_unadjusted(spark, d):
    """The whole series of each entity."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_extendedprice").alias("c"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("a"))
    return clean.unadjusted(li, "entity", "c", "a", 0.05037).withColumn("gap", F.round("gap", 4))


@query("SELECT entity, date, CASE WHEN r IS NOT NULL THEN round(least(greatest(r, -0.05), 0.05), 6) END AS r FROM rets", "rets")
def p10_winsor_clip(spark, d):
    return rets(spark, d).select("entity", "date", F.round(C.clip(F.col("r"), -0.05, 0.05), 6).alias("r"))


@query("SELECT 0 AS part, CAST(NULL AS BIGINT) AS k, 1.0::DOUBLE AS v UNION ALL SELECT 1, o_orderkey, o_totalprice FROM orders")
def u01_union_with_seed(spark, d):
    seed = spark.range(1).select(F.lit(0).alias("part"), F.lit(None).cast("long").alias("k"), F.lit(1.0).alias("v"))
    return seed.unionByName(table(spark, d, "orders").select(F.lit(1).alias("part"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")))


@query("SELECT k, min(t) AS first FROM (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS t FROM orders UNION ALL SELECT user_id, CAST(ts AS DATE) FROM events) WHERE k NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def u02_first_seen(spark, d):
    both = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("t")).unionByName(table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("ts").cast("date").alias("t")))
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return both.groupBy("k").agg(F.min("t").alias("first")).join(known, "k", "left_anti")


@query(f"WITH {_TWICE} , y AS (SELECT k, m, v FROM x QUALIFY row_number() OVER (PARTITION BY k, m ORDER BY seq DESC) = 1) SELECT k, m, v FROM y QUALIFY row_number() OVER (PARTITION BY k ORDER BY m DESC) <= 2")
def u03_concat_dedupe_tail(spark, d):
    from tessera.operators.returns import last_rows

    x = _twice(spark, d)
    return last_rows(src.append_last_wins(x.where("src = 'O'"), x.where("src <> 'O'"), ["k", "m"]), "k", "m", 2).select("k", "m", "v")


@query("SELECT k, 'both' AS part FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT k, 'only' FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def u04_intersect_and_except(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    a, b = (o.where(F.col("o_orderstatus") == s).select("k") for s in "FP")
    return a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.subtract(b).withColumn("part", F.lit("only")))


@query("SELECT 'big' AS index, p_partkey AS entity FROM part WHERE p_size > 25 UNION ALL SELECT 'dear', p_partkey FROM part WHERE p_retailprice > 1000")
def u05_index_members(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("entity"), (F.col("p_size") > 25).alias("big"), (F.col("p_retailprice") > 1000).alias("dear"))
    return src.memberships(p, "entity", ["big", "dear"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def t01_top_n(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(25)


@query(", v AS (SELECT sector, entity, stddev_samp(r) AS vol FROM rets JOIN sect USING (entity) GROUP BY 1, 2) SELECT sector, entity, round(vol, 6) AS vol FROM v QUALIFY row_number() OVER (PARTITION BY sector ORDER BY vol, entity) <= greatest(2, count(*) OVER (PARTITION BY sector) // 3)", "rets", "sect")
def t03_smallest_third(spark, d):
    v = rets(spark, d).join(sect(spark, d), "entity").groupBy("sector", "entity").agg(F.stddev_samp("r").alias("vol"))
    w = Window.partitionBy("sector")
    v = v.withColumn("rn", F.row_number().over(w.orderBy("vol", "entity"))).withColumn("n", F.count(F.lit(1)).over(w))
    return v.where(F.col("rn") <= F.greatest(F.lit(2), F.floor(F.col("n") / 3))).select("sector", "entity", *r6("vol"))


@query("SELECT l_partkey AS entity, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY max(CASE WHEN l_returnflag = 'R' AND l_quantity > 49 THEN 0 ELSE 1 END) , n DESC, entity LIMIT 40")
def t04_universe_cap(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("entity")).agg(F.count(F.lit(1)).alias("n"), F.max(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49), 0).otherwise(1)).alias("flag"))
    return g.orderBy("flag", F.desc("n"), "entity").limit(40).select("entity", "n")


@query("SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def f01_tolerant_cast(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", C.number(F.regexp_extract("props", "([0-9]+)", 1)).alias("k"), C.number(F.col("event_type")).alias("bad"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS key, TRY_CAST(o_orderstatus AS DATE) AS bad FROM orders")
def f02_date_keys(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", C.date_key(F.col("o_orderdate")).alias("key"), C.date_key(F.col("o_orderstatus")).alias("bad"))


@query("SELECT month, month + CAST((12 - isodow(month)) % 7 AS INTEGER) + 14 AS expiry FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders) WHERE month(month) IN (3, 6, 9, 12)")
def f03_third_fridays(spark, d):
    m = table(spark, d, "orders").select(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).distinct().where(F.month("month").isin(3, 6, 9, 12))
    return m.withColumn("expiry", C.third_friday(F.col("month")))


@query("SELECT p_partkey, upper(substr(regexp_replace(regexp_replace(p_name || ' / ' || p_brand, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 24)) AS slug FROM part")
def f04_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", C.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


@query("SELECT c_custkey, CASE WHEN upper(trim(' ' || CASE WHEN c_acctbal < 0 THEN 'none' ELSE c_mktsegment END || '  ')) = 'NONE' THEN NULL ELSE upper(c_mktsegment) END AS token FROM customer")
def f05_token(spark, d):
    x = F.concat(F.lit(" "), F.when(F.col("c_acctbal") < 0, "none").otherwise(F.col("c_mktsegment")), F.lit("  "))
    return table(spark, d, "customer").select("c_custkey", C.token(x).alias("token"))


@query("SELECT o_orderkey, CASE trim(part) WHEN '1-URGENT' THEN 'core' WHEN 'O' THEN 'open' ELSE lower(trim(part)) END AS name FROM (SELECT o_orderkey, unnest(string_split(o_orderpriority || ', ' || o_orderstatus, ',')) AS part FROM orders)")
def f06_aliases(spark, d):
    alias = F.create_map(F.lit("1-URGENT"), F.lit("core"), F.lit("O"), F.lit("open"))
    o = table(spark, d, "orders").select("o_orderkey", F.explode(F.split(F.concat_ws(", ", "o_orderpriority", "o_orderstatus"), ",")).alias("part"))
    return o.select("o_orderkey", F.coalesce(F.try_element_at(alias, F.trim("part")), F.lower(F.trim("part"))).alias("name"))


@query("SELECT s_nationkey AS nation, string_agg(s_name, ',' ORDER BY s_name) AS members FROM (SELECT DISTINCT s_nationkey, s_name FROM supplier) GROUP BY 1")
def f07_member_list(spark, d):
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.concat_ws(",", F.array_sort(F.collect_set("s_name"))).alias("members"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 10 THEN 'small' WHEN l_quantity <= 30 THEN 'mid' ELSE 'large' END AS bin FROM lineitem")
def f08_bins(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.bins(F.col("l_quantity"), [10, 30], ["small", "mid", "large"]).alias("bin"))


@query("SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS s, round(ln(greatest(o_totalprice - 250000, 1e-12)), 6) AS l, round(exp(o_totalprice / 500000), 6) AS e, coalesce(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END, 0) AS c FROM orders")
def f09_scalar_functions(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sqrt(p), 6).alias("s"), F.round(F.log(F.greatest(p - 250000, F.lit(1e-12))), 6).alias("l"), F.round(F.exp(p / 500000), 6).alias("e"), F.coalesce(F.when(F.col("o_orderstatus") == "O", p), F.lit(0.0)).alias("c"))


@query("SELECT o_custkey AS entity, count(*) FILTER (o_orderstatus = 'F') AS filled, count(*) FILTER (o_totalprice > 400000) AS large FROM orders GROUP BY 1")
def x04_conditional_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.count_if(F.col("o_totalprice") > 400000).alias("large"))


