"""Behaviour of single operators on small frames: threshold cases, edge cases, recursions against plain loops, sinks and streams."""

import datetime as dt
import math
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import alerts, asof, backtest, clean, grouped, index, pairs, peers, ranks, regimes, returns, risk, screens, windows
from tessera.sources import tables as src
from tessera.streaming import panels

D = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(400)]
UNIT = {"roe": 0.15, "roic": 0.15, "de": 0.5, "ev": 8.0, "pb": 1.2, "mca": 0.3, "stab": 0.6, "ic": 6.0}


def one(spark, **changes):
    row = UNIT | changes
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))


# --- thresholds


def test_unit_row_passes_all_legs(spark):
    r = screens.with_legs(one(spark)).first()
    assert r.dual_pass and r.n_failed == 0 and r.failed_legs == ""


@pytest.mark.parametrize(("change", "failed"), [({"roic": 0.10}, "roic"), ({"mca": 0.9}, "mca"), ({"roe": None}, "roe"), ({"ev": None, "pb": 9.0}, "ev,pb")])
def test_failed_legs(spark, change, failed):
    r = screens.with_legs(one(spark, **change)).first()
    assert r.failed_legs == failed and not r.dual_pass


def test_regimes_tighten_and_ease(spark):
    t = screens.THRESHOLDS
    assert t["high_vol_stress"]["ev"] < t["normal"]["ev"] < t["low_vol"]["ev"]
    assert t["high_vol_stress"]["roe"] >= t["normal"]["roe"]


@pytest.mark.parametrize(("p", "label", "want"), [([0.4, 0.3, 0.3], "low_vol", "uncertain"), ([0.05, 0.9, 0.05], "low_vol", "low_vol"), ([0.9, 0.1], "unknown", "normal"), ([0.9, 0.1], None, "normal")])
def test_soft_posterior_rule(spark, p, label, want):
    df = spark.createDataFrame([(p, label)], "p array<double>, label string")
    assert df.select(screens.select_regime(F.col("p"), F.col("label"))).first()[0] == want


def test_gap_signs(spark):
    r = one(spark, roe=0.1, ev=10.0, pb=None).select(*[v.alias(k) for k, v in screens.gaps().items()]).first()
    assert r.roe_gap < 0 and r.ev_gap < 0 and r.de_gap > 0 and r.pb_gap is None


def test_lower_is_better_is_not_always_zero(spark):
    a = one(spark).select(screens.value_score()).first()[0]
    b = one(spark, ev=30.0, pb=9.0, mca=9.0).select(screens.value_score()).first()[0]
    assert a == pytest.approx(1.0) and b == 0.0


# --- scalar helpers


def test_bins_slug_token_and_dates(spark):
    df = spark.createDataFrame([(5.0, " n/a ", "A & B-c", dt.date(2024, 3, 1), "x"), (None, "ok", "", dt.date(2024, 6, 1), "2024-01-02")], "v double, t string, s string, m date, d string")
    r = df.select(C.bins(F.col("v"), [5, 10], ["a", "b", "c"]), C.token(F.col("t")), C.slug(F.col("s")), C.third_friday(F.col("m")), C.date_key(F.col("d")), C.number(F.col("d"))).collect()
    assert tuple(r[0]) == ("a", None, "A_B_C", dt.date(2024, 3, 15), None, None)
    assert tuple(r[1]) == (None, "OK", "", dt.date(2024, 6, 21), dt.date(2024, 1, 2), None)


def test_percentile_rank_matches_pandas(spark):
    x = [3.0, 1.0, None, 3.0, 2.0, None, 3.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double")
    from pyspark.sql import Window

    got = {r.i: r.p for r in df.withColumn("p", C.pct_rank(F.col("v"), Window.partitionBy())).collect()}
    want = pd.Series(x).rank(pct=True)
    assert all((got[i] is None and math.isnan(w)) or got[i] == pytest.approx(w) for i, w in enumerate(want))


def test_ranks_of_whole_tables_match_pandas(spark):
    rng = np.random.default_rng(9)
    x = pd.Series(rng.integers(0, 40, 300).astype(float)).where(rng.random(300) > 0.1)
    df = spark.createDataFrame([(i, None if v != v else float(v)) for i, v in enumerate(x)], "i int, v double")
    got = ranks.with_rank(ranks.with_zscores(ranks.with_pct_ranks(df, {"p": "v"}), {"z": "v"}), "v").orderBy("i").toPandas()
    assert np.allclose(got.p, x.rank(pct=True), equal_nan=True) and np.allclose(got.z, ((x - x.mean()) / x.std()).fillna(0))
    assert (got["rank"] == x.rank(ascending=False, method="min", na_option="bottom")).all()
    b = peers.even_buckets(df.where("v IS NOT NULL"), ["v", "i"]).groupBy("bucket").count().orderBy("bucket").toPandas()
    assert b.bucket.tolist() == [1, 2, 3, 4, 5] and b["count"].max() - b["count"].min() <= 1


def test_step_up_filter_equals_the_textbook_rule(spark):
    rng = np.random.default_rng(10)
    p = np.concatenate([rng.random(80), rng.random(20) * 0.01]).round(4)
    df = spark.createDataFrame([(k % 2, k, float(v)) for k, v in enumerate(p)], "g int, k int, p double")

    def keep(v, alpha):
        s = np.sort(v)
        ok = np.flatnonzero(s <= alpha * np.arange(1, len(s) + 1) / len(s))
        return v <= s[ok[-1]] if len(ok) else np.zeros(len(v), bool)

    got = pairs.step_up(df, "p", 0.2, ties=["k"]).orderBy("k").toPandas()
    assert got.survives.tolist() == keep(p, 0.2).tolist()
    by = pairs.step_up(df, "p", 0.2, ["g"], ["k"]).orderBy("k").toPandas()
    for g in (0, 1):
        assert by[by.g == g].survives.tolist() == keep(p[np.arange(100) % 2 == g], 0.2).tolist()
    x = df.select(C.normal_tail(F.lit(1.959963984540054)), C.normal_tail(F.lit(-1.0)), pairs.corr_p_value(F.lit(0.5), F.lit(30))).first()
    assert x[0] == pytest.approx(0.025, abs=1e-7) and x[1] == pytest.approx(0.8413447, abs=1e-7) and x[2] == pytest.approx(2 * 0.5 * math.erfc(0.5 * math.sqrt(28 / 0.75) / math.sqrt(2)), abs=2e-7)


def test_tied_rows_give_one_answer(spark):
    rows = [("a", D[0], 1.0), ("a", D[0], 2.0), ("a", D[0], 3.0)]
    pick = lambda x: returns.latest(spark.createDataFrame(x, "k string, t date, v double"), "k", "t").first().v
    assert pick(rows) == pick(rows[::-1])
    new = spark.createDataFrame([("a", 1, 9.0)], "k string, seq int, v double")
    assert src.append_last_wins(spark.createDataFrame([("a", 1, 5.0)], "k string, seq int, v double"), new, ["k"]).first().v == 9.0


def test_quintiles_match_pandas_qcut(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=200), 1)
    df = spark.createDataFrame([("g", float(v)) for v in x], "g string, v double")
    got = sorted((r.v, r.bucket) for r in peers.quintile(df, "g", "v").collect())
    want = sorted(zip(x.tolist(), (pd.qcut(x, 5, labels=False, duplicates="drop") + 1).tolist(), strict=True))
    assert got == want


def test_constant_series_give_null_not_errors(spark):
    df = spark.createDataFrame([("a", D[k], 5.0, 1.0) for k in range(30)], "entity string, date date, price double, m double")
    r = returns.with_returns(df, "entity", "date", "price")
    assert windows.rolling_pair(r.where("r IS NOT NULL"), "entity", "date", "r", "m", 5).agg(F.count("beta"), F.count("corr")).first() == (0, 0)
    assert risk.ann_stats(r, ["entity"], "r").first().sharpe is None
    assert r.groupBy("entity").agg(C.safe_corr(F.col("r"), F.col("m")).alias("c")).first().c is None
    flat = clean.flat_runs(df, "entity", "date", "price", 5).first()
    assert flat.longest == 30


# --- identities


def test_index_identities(spark):
    rng = np.random.default_rng(2)
    rows = [(e, D[30 * t], float(rng.uniform(5, 9)), float(rng.uniform(1, 4)), "u") for e in range(6) for t in range(8)]
    df = spark.createDataFrame(rows, "entity int, date date, price double, qty double, universe string")
    out = index.fisher_chain(df, "entity", "date", "price", "qty", ["universe"]).orderBy("date").toPandas()
    assert len(out) == 8 and out.fisher_p.iloc[0] == 100
    assert np.allclose(out.fisher_p**2, out.laspeyres_p * out.paasche_p)
    value = pd.DataFrame(rows, columns=["e", "d", "p", "q", "u"]).assign(v=lambda x: x.p * x.q).groupby("d").v.sum()
    assert np.allclose(out.fisher_p * out.fisher_q / 1e4, value / value.iloc[0])
    rates = index.rates(index.fisher_chain(df, "entity", "date", "price", "qty", ["universe"]), ["universe"], "date").toPandas()
    assert np.nanmax(np.abs(rates.gap)) < 1e-12


def test_asof_ties_and_missing(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5), ("a", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 3, "x"), ("a", 4, None), ("c", 1, "z")], "k string, u int, v string")
    got = {(r.k, r.t): (r.u, r.v) for r in asof.asof(left, right, "t", "u", ["u", "v"], ["k"]).collect()}
    assert got == {("a", 5): (4, None), ("a", 1): (None, None), ("b", 5): (None, None), ("a", 3): (3, "x")}
    ahead = {(r.k, r.t): r.u for r in asof.asof(left, right, "t", "u", ["u"], ["k"], forward=True).collect()}
    assert ahead == {("a", 5): None, ("a", 1): 3, ("b", 5): None, ("a", 3): 3}


def test_lots_match_first_in_first_out(spark):
    trades = [("a", D[0], 1, 10.0, 5.0), ("a", D[1], 2, 5.0, 6.0), ("a", D[2], 3, -12.0, 7.0), ("a", D[3], 4, -2.0, 4.0), ("b", D[0], 5, -3.0, 1.0)]
    df = spark.createDataFrame(trades, "e string, t date, s int, q double, p double")
    got = sorted((r.buy, r.sell, r.qty, r.pl) for r in backtest.match_lots(df, "e", "t", "s", "q", "p").collect())
    assert got == [(1, 3, 10.0, 20.0), (2, 3, 2.0, 2.0), (2, 4, 2.0, -4.0)]


# --- recursions against loops


def test_indicators_and_filters_equal_loops(spark):
    rng = np.random.default_rng(3)
    p = 100 + np.cumsum(rng.normal(size=60))
    df = spark.createDataFrame([("a", D[k], float(v)) for k, v in enumerate(p)], "entity string, date date, price double")
    out = grouped.indicators(df, "entity", "date", "price").orderBy("date").toPandas()
    fast = slow = p[0]
    macd = []
    for v in p:
        fast, slow = (v if not macd else fast + (v - fast) * 2 / 13), (v if not macd else slow + (v - slow) * 2 / 27)
        macd.append(fast - slow)
    assert np.allclose(out.macd, macd)
    assert out.rsi.iloc[:14].isna().all() and out.rsi.iloc[14:].between(0, 100).all()
    x = spark.createDataFrame([("a", D[0], 1.0, 5.0), ("a", D[1], None, 6.0), ("a", D[2], 3.0, 7.0), ("b", D[0], 4.0, None)], "k string, date date, x double, y double")
    a, b = (sorted(f.collect(), key=lambda r: (r.k, r.date)) for f in (grouped.kalman(x, ["k"], "date", "x", 0.1, 1.0), grouped.kalman_two(x, ["k"], "date", "x", "y", 0.1, 1.0)))
    assert a[0].gain == pytest.approx(1.1 / 2.1) and a[1].gain is None and a[1].level == a[0].level and a[2].innovation == pytest.approx(3 - a[1].level) and a[3].gain == a[0].gain
    assert b[1].level_y == b[0].level_y and b[1].innovation_y is None and b[3].gain is None and b[3].level_x == 0.0  # both values or neither


def test_series_of_any_length_equal_loops_over_block_ends(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(e, D[k], float(v)) for e in range(40) for k, v in enumerate(100 + np.cumsum(rng.normal(size=int(rng.integers(1, 70)))))]
    df = spark.createDataFrame(rows, "entity int, date date, price double")
    want = {}
    for e in range(40):
        p = [v for k, _, v in rows if k == e]
        atr = p[0]
        for k, v in enumerate(p):
            atr = v if k == 0 else atr + (v - atr) / 14
            want[e, D[k]] = atr if k >= 13 else None  # as many rows as the average
    for block in (7, 100_000):
        monkeypatch.setattr(grouped, "BLOCK_ROWS", block)
        got = {(r.entity, r.date): r.atr for r in grouped.average_true_range(df, "entity", "date", "price").collect()}
        assert got.keys() == want.keys() and all(got[k] is None if want[k] is None else got[k] == pytest.approx(want[k]) for k in want)
    last = grouped.indicators(df, "entity", "date", "price").where("entity = 0").orderBy("date").toPandas()
    s = pd.Series([v for k, _, v in rows if k == 0])
    assert np.allclose(last.sma_short, s.rolling(20).mean(), equal_nan=True) and np.allclose(last.bb_upper, s.rolling(20).mean() + 2 * s.rolling(20).std(), equal_nan=True)


def test_pair_trades_profit_from_reversion(spark):
    z = [0.0, 2.5, 1.0, 0.2, 0.0, -2.2, -5.0, 0.0]
    df = spark.createDataFrame([("a|b", D[k], v) for k, v in enumerate(z)], "pair string, date date, z double")
    out = grouped.pair_trades(df, ["pair"], "date", "z").orderBy("entry_date").toPandas()
    assert out.reason.tolist() == ["revert", "stop"] and out.bars_held.tolist() == [2, 1] and out.pnl.tolist() == [pytest.approx(2.3), pytest.approx(-2.8)]
    flip = grouped.pair_trades(df, ["pair"], "date", "z", mean_reverting=False).orderBy("entry_date").toPandas()
    assert flip.pnl.tolist() == [pytest.approx(-2.3), pytest.approx(2.8)]


def test_lead_lag_finds_the_leader(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=200)
    y = np.concatenate([[0], x[:-1]]) + 0.1 * rng.normal(size=200)
    rows = [("a", "b", D[k], float(x[k]), float(y[k])) for k in range(200)] + [("b", "a", D[k], float(y[k]), float(x[k])) for k in range(200)]
    f = {r.a: r.f for r in grouped.lead_lag(spark.createDataFrame(rows, "a string, b string, date date, x double, y double"), ["a", "b"], "date").collect()}
    assert f["a"] > 50 > f["b"]


def test_bootstrap_is_repeatable_and_bounded(spark):
    rng = np.random.default_rng(5)
    rows = [("calm", D[k], 0.001) for k in range(50)] + [("wild", D[k], float(v)) for k, v in enumerate(rng.normal(-0.05, 0.2, 50))]
    df = spark.createDataFrame(rows, "entity string, date date, r double")
    run = lambda x: {r.entity: (r.p_ruin, r.p_drop) for r in risk.bootstrap(spark, x, "entity", "date", "r", 30, 5, 6, 9).collect()}
    got = run(df)
    assert got == run(df.repartition(5)) and got["calm"] == (0.0, 0.0) and got["wild"][1] > 0.5


def test_mixture_states_are_ordered_and_sum_to_one(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(rng.normal(0, 1)), float(abs(rng.normal(1 if k < 60 else 5, 0.3)))) for k in range(120)]
    out = regimes.mixture_labels(spark.createDataFrame(rows, "t int, m double, vol double"), ["m", "vol"], "vol", 2).toPandas()
    assert (out[out.t < 60].state == 0).mean() > 0.95 and (out[out.t >= 60].state == 1).mean() > 0.95
    assert np.allclose([sum(p) for p in out.posterior], 1)


# --- sources, sinks and streams


def test_csv_defaults_and_required_columns(spark):
    at = tempfile.mkdtemp(prefix="spark-")
    with open(f"{at}/a.csv", "w") as f:
        f.write("date,entity,open,close\n2024-01-02,x,5,7\nbad,y,,3\n")
    r = {x.entity: x for x in src.csv_prices(spark, f"{at}/a.csv").collect()}
    assert (r["x"].high, r["x"].low, r["x"].volume, r["x"].source, r["x"].date) == (7.0, 5.0, 0.0, "csv", dt.date(2024, 1, 2)) and r["y"].date is None
    with open(f"{at}/b.csv", "w") as f:
        f.write("date,open\n2024-01-02,5\n")
    with pytest.raises(ValueError, match="entity"):
        src.csv_prices(spark, f"{at}/b.csv")


def test_staged_merge_and_group_replacement(spark):
    at = tempfile.mkdtemp(prefix="spark-")
    df = spark.createDataFrame([("u", "D", 1), ("u", "W", 2), ("v", "D", 3)], "universe string, freq string, x int")
    src.merge_staged(df, df, f"{at}/m")
    assert spark.read.parquet(f"{at}/m").count() == 6
    src.replace_groups(df, f"{at}/g", ["universe", "freq"])
    src.replace_groups(spark.createDataFrame([("u", "D", 9)], df.schema), f"{at}/g", ["universe", "freq"])
    assert sorted(r.x for r in spark.read.parquet(f"{at}/g").collect()) == [2, 3, 9]
    assert src.prefer(spark, f"{at}/none", f"{at}/m").count() == 6


def test_streams_equal_their_batch_forms(spark):
    at = tempfile.mkdtemp(prefix="spark-")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k % 3, t0 + dt.timedelta(hours=k), float(k), 1.0, k) for k in range(72)]
    df = spark.createDataFrame(rows, "entity int, ts timestamp, price double, qty double, seq int")
    live = panels.as_stream(df, f"{at}/bars", lambda s: panels.bars(s, "entity", "ts", "price", "qty"), "live_bars", "append")
    batch = panels.bars(df, "entity", "ts", "price", "qty")
    closed = batch.where(F.col("start") < F.lit(t0 + dt.timedelta(days=2)))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, closed.collect()))
    rules = spark.createDataFrame([("r", "*", "above", 69.0)], "rule_id string, target string, side string, level double")
    assert panels.as_stream(df, f"{at}/lv", lambda s: panels.level_alerts(s, rules), "live_level").count() == 2
    hits = panels.as_stream(df, f"{at}/mean", lambda s: panels.mean_alerts(s, 5), "live_mean").collect()
    assert len(hits) == 3 * (24 - 5) and all(h.price > h.mean for h in hits)
    calm = panels.as_stream(df.where("hour(ts) < 3"), f"{at}/sess", lambda s: panels.spells(s.where("entity = 0"), "entity", "ts"), "live_spells", "append")
    assert calm.count() >= 1


def test_append_stream_keeps_the_last_write(spark):
    at = tempfile.mkdtemp(prefix="spark-")
    t0 = dt.datetime(2024, 1, 1)
    schema = "entity int, ts timestamp, price double, seq int"
    spark.createDataFrame([(1, t0, 5.0, 1), (1, t0, 6.0, 2), (2, t0, 1.0, 1), (1, t0, 6.0, 2)], schema).write.parquet(f"{at}/in")
    q = panels.append_stream(spark.readStream.schema(schema).parquet(f"{at}/in"), f"{at}/out", ["entity", "ts"], "ts").trigger(availableNow=True).option("checkpointLocation", f"{at}/cp").start()
    q.awaitTermination()
    spark.createDataFrame([(2, t0, 9.0, 3)], schema).write.mode("append").parquet(f"{at}/in")
    q = panels.append_stream(spark.readStream.schema(schema).parquet(f"{at}/in"), f"{at}/out", ["entity", "ts"], "ts").trigger(availableNow=True).option("checkpointLocation", f"{at}/cp").start()
    q.awaitTermination()
    assert sorted((r.entity, r.price) for r in panels.current(spark, f"{at}/out").collect()) == [(1, 6.0), (2, 9.0)]
    import os

    def files():
        return {x: os.path.getmtime(x) for x in panels.current(spark, f"{at}/out").inputFiles() for x in [x.removeprefix("file://")]}

    before = files()
    spark.createDataFrame([(5, t0 + dt.timedelta(days=1), 2.0, 4)], schema).write.mode("append").parquet(f"{at}/in")
    q = panels.append_stream(spark.readStream.schema(schema).parquet(f"{at}/in"), f"{at}/out", ["entity", "ts"], "ts").trigger(availableNow=True).option("checkpointLocation", f"{at}/cp").start()
    q.awaitTermination()
    assert before.items() <= files().items()  # other days stay as they are
    assert panels.current(spark, f"{at}/out").count() == 3


# --- alerts, ratios, empty tables


def test_alert_rules_need_enough_rows(spark):
    panel = spark.createDataFrame([("a", D[k], float(k), 10.0) for k in range(4)] + [("b", D[0], 1.0, 1.0)], "entity string, date date, price double, qty double")
    rules = spark.createDataFrame([("m", "sma_above", "*", 3.0, None, True, "high"), ("h", "new_high", "a", 4.0, None, True, "low"), ("v", "volume_spike", "*", 5.0, 2.0, True, "high")], "rule_id string, rule_type string, target string, p1 double, p2 double, enabled boolean, priority string")
    got = sorted((r.rule_id, r.entity) for r in alerts.run(rules, panel).collect())
    assert got == [("h", "a"), ("m", "a")]
    at = tempfile.mkdtemp(prefix="spark-") + "/log"
    for stamp in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        alerts.append_log(alerts.run(rules, panel, at=stamp), at)
    assert sorted((r.rule_id, str(r.run_at)) for r in spark.read.parquet(at).collect()) == [("h", "2024-01-01 00:00:00"), ("h", "2024-01-02 00:00:00"), ("m", "2024-01-01 00:00:00"), ("m", "2024-01-02 00:00:00")]
    assert sorted(r.rule_id for r in alerts.run(rules, panel, priority="high", target="a").collect()) == ["m"]


def test_ratios_treat_zero_as_missing(spark):
    from tessera.operators import decisions

    cols = "ttm_ni equity debt cash ttm_oi ttm_int ttm_da assets shares price invested tax_rate".split()
    df = spark.createDataFrame([(1.0, 0.0, 2.0, 0.0, 3.0, 0.0, 1.0, 5.0, 6.0, 7.0, None, None)], ", ".join(f"{c} double" for c in cols))
    r = decisions.ratios(df).first()
    assert r.roe is None and r.coverage is None and r.market_cap == 42 and r.ev_ebitda == 11.0 and r.roic == pytest.approx(3 * 0.75 / 2)


def test_operators_take_empty_tables(spark):
    e = spark.createDataFrame([], "entity string, date date, price double, qty double, r double, high double, low double")
    assert returns.with_returns(e, "entity", "date", "price").count() == 0
    assert clean.clean_prices(e, "entity", "date", "price", "qty").count() == 0
    assert index.fisher_chain(e, "entity", "date", "price", "qty", []).count() <= 1
    assert risk.hill(e, ["entity"], "r").count() == 0
    assert backtest.purged_folds(e, "entity", "date", 3, 1).count() == 0
    assert peers.quintile(e, "entity", "price").count() == 0
    assert pairs.step_up(e, "price").count() == 0 and ranks.with_pct_ranks(e, {"p": "price"}).count() == 0
    assert grouped.indicators(e, "entity", "date", "price").count() == 0
    assert returns.densify(e, "entity", "date", "price", "qty").count() == 0
