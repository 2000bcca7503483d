"""Operators that spread large groups over tasks, against the plain forms of the same thing."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import safe_corr
from tessera.operators import blocks, pairs, quantiles

PANEL = "entity long, date date, r double, sector string"


def panel(spark, seed=2, entities=23, dates=40):
    """Series with gaps, a constant one, one of a single date, null and NaN values."""
    rng = random.Random(seed)
    rows = []
    for e in range(entities):
        for t in range(dates):
            if rng.random() < 0.8:
                rows.append((e, datetime.date(2020, 1, 1) + datetime.timedelta(t), 0.25 if e == 5 else rng.gauss(0, 1) + t * 0.01 * e, "one" if e % 3 else None))
    rows += [(100, datetime.date(2020, 1, 3), 1.0, "one"), (101, datetime.date(2020, 1, 3), None, "one"), (102, datetime.date(2020, 1, 4), float("nan"), "one"), (None, datetime.date(2020, 1, 4), 1.0, "one")]
    return spark.createDataFrame(rows, PANEL)


def same(got, want, keys):
    columns = want.columns
    a = sorted((tuple(r[c] for c in columns) for r in got.select(*columns).collect()), key=lambda r: tuple(str(v) for v in r[:keys]))
    b = sorted((tuple(r) for r in want.collect()), key=lambda r: tuple(str(v) for v in r[:keys]))
    assert [r[:keys] for r in a] == [r[:keys] for r in b] and a
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x[keys:], y[keys:], strict=True):
            assert (u is None) == (v is None) and (u is None or math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9)), (x, y)


@pytest.fixture(params=[(256, 1 << 20), (4, 1 << 20), (256, 150)], ids=["one block", "small blocks", "few values"])
def sized(request, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_SERIES", request.param[0])
    monkeypatch.setattr(blocks, "BLOCK_VALUES", request.param[1])


def self_join(p, by):
    return pairs.paired(p.where("NOT isnan(r)").fillna("none", ["sector"]), "entity", "date", "r", by)


def test_pair_statistics_equal_the_self_join(spark, sized):
    p = panel(spark)
    by = ["sector"]
    same(blocks.pair_stats(p.fillna("none", ["sector"]), "entity", "date", "r", by, 3), pairs.pair_stats(self_join(p, by), by, 3).select("sector", "a", "b", "n", "corr", "cov", "beta", "alpha"), 4)
    same(blocks.pair_stats(p, "entity", "date", "r", [], 1).select("a", "b", "n"), self_join(p, []).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), 3)
    labels = p.select("date").distinct().select("date", F.explode(F.when(F.dayofmonth("date") < 9, F.array(F.lit("early"), F.lit("all"))).otherwise(F.array(F.lit("all")))).alias("label"))
    want = self_join(p, []).join(labels, "date").groupBy("label", "a", "b").agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("x"), F.col("y")).alias("corr")).where("n >= 4")
    same(blocks.pair_stats(p, "entity", "date", "r", [], 4, labels=labels), want, 4)
    assert blocks.pair_stats(p.where("false"), "entity", "date", "r", by).count() == 0


def test_rolling_pair_correlations_equal_the_self_join(spark, sized):
    p = panel(spark)
    plain = pairs.rolling_corr(self_join(p, []), [], "date", 7)
    want = plain.groupBy("date").agg(F.count("corr").alias("n"), F.avg("corr").alias("mean_corr"), F.stddev_samp("corr").alias("std_corr"))
    same(blocks.rolling_by_time(p, "entity", "date", "r", [], [7, 9]).where("rows = 7"), want, 2)
    by_pair = plain.where("corr IS NOT NULL").groupBy("a", "b").agg(F.count("corr").alias("n"), F.avg("corr").alias("mean"), F.stddev_samp("corr").alias("std"), (F.max("corr") - F.min("corr")).alias("span"), (F.percentile("corr", F.lit(0.75)) - F.percentile("corr", F.lit(0.25))).alias("iqr"), F.avg((F.col("corr") > 0).cast("double")).alias("positive"))
    same(blocks.rolling_by_pair(p, "entity", "date", "r", [], 7), by_pair, 3)


def test_ewma_tails_and_reversion_equal_the_self_join(spark, sized):
    p = panel(spark)
    j = self_join(p, [])
    same(blocks.ewma_cov(p, "entity", "date", "r", []), pairs.ewma_cov(j, [], "date").select("a", "b", "ewma"), 2)
    same(blocks.tail_dependence(p, "entity", "date", "r", [], 0.2, 10), pairs.tail_dependence(j, [], 0.2, 10).select("a", "b", "upper", "lower"), 2)
    k = pairs.pair_stats(j, []).where("beta IS NOT NULL").select("a", "b", "beta")
    s = j.join(k, ["a", "b"]).withColumn("s", F.col("y") - F.col("beta") * F.col("x"))
    got = blocks.reversion(p.where("entity NOT IN (5, 100)"), "entity", "date", "r", [])
    same(got, k.join(pairs.half_life(s, ["a", "b"], "date", "s"), ["a", "b"]).where("a NOT IN (5, 100) AND b NOT IN (5, 100)").select("a", "b", "beta", "rho", "t", "half_life"), 2)


@pytest.mark.parametrize(("rows", "splits"), [(100_000, 256), (5, 4), (1, 2)])
def test_quantiles_equal_percentile(spark, monkeypatch, rows, splits):
    monkeypatch.setattr(quantiles, "BUCKET_ROWS", rows)
    monkeypatch.setattr(quantiles, "SPLITS", splits)
    rng = random.Random(rows)
    data = [("normal", rng.gauss(0, 1e6)) for _ in range(300)] + [("tied", float(rng.choice([1, 1, 1, 2, 7]))) for _ in range(200)] + [("wide", 10.0 ** rng.randint(-200, 200)) for _ in range(99)] + [("one", 3.5), ("none", None), (None, -0.0), (None, 4.0), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(data, "g string, v double")
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    want = df.where("v IS NOT NULL").groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in wanted.items()])
    same(quantiles.quantiles(df, ["g"], "v", wanted), want, 1)
    whole = df.agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in wanted.items()])
    same(quantiles.quantiles(df, [], "v", wanted), whole, 0)
    assert quantiles.quantiles(df.where("false"), ["g"], "v", wanted).count() == 0


@pytest.mark.parametrize("unit", ["year", "month", "day"])
@pytest.mark.parametrize("forward", [False, True])
def test_carried_values_equal_one_window(spark, unit, forward):
    from tessera.operators.asof import carry

    rng = random.Random(7)
    rows = [(rng.choice([1, 2, None]), datetime.date(2020, 1, 1) + datetime.timedelta(rng.randrange(900)), i, rng.choice([None, None, None, float(i)]), rng.choice([None, str(i)])) for i in range(300)]
    rows += [(3, None, 300, 1.5, None), (3, datetime.date(2021, 5, 5), 301, None, None), (4, datetime.date(2020, 1, 1), 302, 2.0, "x"), (4, datetime.date(2022, 12, 31), 303, None, None)]
    df = spark.createDataFrame(rows, "k int, t date, i int, x double, s string")
    turn = F.desc if forward else F.asc
    w = Window.partitionBy("k").orderBy(turn("t"), turn("i")).rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("x", "s")})
    got = carry(df, ["k"], "t", ["x", "s"], ["i"], forward, unit)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("forward", [False, True])
def test_asof_equals_brute_force(spark, by, forward):
    from tessera.operators.asof import asof

    rng = random.Random(11)
    day = lambda: datetime.date(2020, 1, 1) + datetime.timedelta(rng.randrange(700))
    left = [(i, rng.choice([1, 2, 3, None]), rng.choice([day(), day(), datetime.date(2020, 3, 3), None])) for i in range(200)] + [(200, 9, day())]
    right = [(rng.choice([1, 2, 3, None]), day(), float(i)) for i in range(40)] + [(1, None, -1.0), (1, datetime.date(2020, 3, 3), 5.0), (1, datetime.date(2020, 3, 3), 6.0)]
    got = asof(spark.createDataFrame(left, "i int, k int, t date"), spark.createDataFrame(right, "k int, d date, v double"), "t", "d", ["d", "v"], by, forward)
    want = []
    for i, k, t in left:
        fits = [(d, v) for rk, d, v in right if t and d and (not by or rk == k) and (d >= t if forward else d <= t)]
        best = (min if forward else max)(d for d, _ in fits) if fits else None
        want.append((i, k, t, best, max(v for d, v in fits if d == best) if fits else None))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want


def test_one_key_is_spread_over_its_ranges(spark):
    """The plan partitions rows by key and range, so a single key's rows go to many partitions."""
    from tessera.operators.asof import carry

    df = spark.range(0, 3000).selectExpr("1 AS k", "date_add(DATE '2000-01-01', int(id)) AS t", "CASE WHEN id % 10 = 0 THEN double(id) END AS x")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = carry(df, ["k"], "t", ["x"]).groupBy(F.spark_partition_id()).count().collect()
        assert len(got) > 1 and max(r["count"] for r in got) < 3000
        assert carry(df, ["k"], "t", ["x"]).where("x <> floor(datediff(t, DATE '2000-01-01') / 10) * 10").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("block", [60, 97, 5000])
def test_scans_equal_the_steps_through_whole_series(spark, monkeypatch, block):
    from tessera.operators import grouped, scans

    monkeypatch.setattr(scans, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for e, n in ((1, 1000), (2, 61), (3, 5), (4, 1), (None, 130)):
        p = 100.0
        for t in range(n):
            p = max(1.0, p + rng.choice([0, rng.gauss(0, 1)]))
            rows.append((e, datetime.date(2000, 1, 1) + datetime.timedelta(t), p, None if rng.random() < 0.2 else rng.gauss(0, 0.02)))
    df = spark.createDataFrame(rows, "e int, t date, p double, r double")
    names = "rsi macd macd_signal macd_hist bb_upper bb_lower bollinger sma_short sma_long sma_cross".split()
    same(scans.indicators(df, "e", "t", "p", 14, 12, 26, 9, 20, 20, 50), grouped.indicators(df, "e", "t", "p").select("e", "t", *names), 2)
    level = scans.local_level(scans.blocked(df, ["e"], "t", ["r"]), ["e"], "r", 1e-5, 1e-3)
    same(level, grouped.kalman(df, ["e"], "t", "r").select("e", "t", "level", "gain", "innovation"), 2)
    monkeypatch.setattr(scans, "LONG_SERIES", 500)
    assert scans.is_long(df, ["e"]) and not scans.is_long(df.where("e <> 1"), ["e"])
    if block == 97:  # the operators take the scan where a series is long
        same(grouped.average_true_range(df, "e", "t", "p"), grouped.per_series(df, ["e"], "t", ["p"], "atr double", lambda s: {"atr": np.where(s.row >= 13, grouped.ema(s, s.values("p"), 1 / 14), np.nan)}), 2)
        same(grouped.kalman(df, ["e"], "t", "r").select("e", "t", "level", "gain", "innovation"), level.select("e", "t", "level", "gain", "innovation"), 2)
        two = grouped.kalman_two(df, ["e"], "t", "r", "p")
        monkeypatch.setattr(scans, "LONG_SERIES", 10**9)
        same(two, grouped.kalman_two(df, ["e"], "t", "r", "p"), 2)
