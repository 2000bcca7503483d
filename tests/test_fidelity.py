"""Formulas with values worked out by hand from their definitions, not from the library's SQL."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import backtest, decisions, pairs, peers, regimes, risk, screens, windows
from tessera.sources import tables as src

RATIOS = "entity int, roe double, roic double, de double, ev double, pb double, mca double, stab double, ic double"


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_p21_inclusion_ladder(spark):
    good = (0.2, 0.2, 0.5, 5.0, 1.0, 0.3)
    cases = [
        (*good, 0.6), (*good, 0.24), (*good, None), (0.1, 0.1, 2.0, 5.0, 1.0, 0.3, 0.6), (0.2, 0.2, 0.5, 20.0, 3.0, 0.9, 0.6),
        (0.1, 0.2, 0.5, 20.0, 1.0, 0.3, 0.6), (0.1, 0.1, 0.5, 20.0, 3.0, 0.3, 0.6), (None, 0.1, 2.0, 20.0, 3.0, 0.3, 0.6),
    ]
    df = spark.createDataFrame([(i, *c, 6.0) for i, c in enumerate(cases)], RATIOS)
    got = rows(decisions.inclusion(df).orderBy("entity"), "candidacy", "decision", "near")
    assert got == [
        ("INCLUDE", "INCLUDE_CORE", False), ("EXCLUDE", "WATCH", False), ("INCLUDE", "INCLUDE_CORE", False), ("INCLUDE", "INCLUDE_VALUE", False), ("INCLUDE", "INCLUDE_QUALITY", False),
        ("WATCH", "NEAR_DUAL", True), ("WATCH", "WATCH", False), ("EXCLUDE", "AVOID", False),
    ]


@pytest.mark.parametrize(("roe", "de", "name"), [(0.2, 0.5, "high_ops"), (0.2, 1.2, "leverage_driven"), (0.2, 0.9, "mixed"), (-0.1, 0.5, "negative"), (0.1, 0.5, "modest"), (None, 0.5, "unknown"), (0.2, None, "unknown"), (0.15, 0.5, "high_ops"), (0.15, 1.0, "mixed")])
def test_p27_return_class(spark, roe, de, name):
    assert rows(screens.dupont(spark.createDataFrame([(roe, de)], "roe double, de double")), "roe_class") == [(name,)]


BUY = "decision string, momentum double, residual double, factor double, aggregate double, flag string, liquidity double, fragile boolean, skew double, member boolean, stress boolean"


def test_p29_buy_score(spark):
    cases = [
        (("INCLUDE_CORE", 0.6, 0.06, 0.6, 0.8, "cheap-assets", 0.5, False, 0.1, True, False), 1.18, "BUY", "dual_pass_core,strong_momentum,positive_residual_mom,high_factor_composite,aggregate_top,cheap_assets_flag,sp500_member"),
        (("SATELLITE", 0.1, 0.05, 0.1, 0.6, "levered-assets", 0.1, False, 0.1, False, False), 0.16, "WATCH", "satellite,positive_momentum,aggregate_strong,levered_assets_flag,low_liquidity"),
        (("AVOID", -0.6, None, -1.0, 0.2, "", None, True, 0.35, False, True), -1.08, "AVOID", "decision_avoid,weak_momentum,aggregate_weak,fragile_veto,skew_steepening,stress_regime_haircut"),
        ((None,) * 10 + (False,), 0.0, "AVOID", ""),
        ((None,) * 10 + (True,), -0.13, "AVOID", "stress_regime_haircut"),
        (("INCLUDE_VALUE", 0.5, 0.2, 0.5, 0.5, None, 0.15, None, None, None, False), 0.45, "ACCUMULATE", "value_trifecta,positive_momentum,positive_residual_mom"),
        (("INCLUDE_QUALITY", 0.3, None, None, 0.75, None, None, None, None, True, True), 0.52, "ACCUMULATE", "buffett_quality,positive_momentum,aggregate_top,sp500_member,stress_regime_haircut"),
    ]
    for inputs, score, action, reasons in cases:
        r = decisions.buy_score(spark.createDataFrame([inputs], BUY)).first()
        assert (round(r.score, 9), r.action, r.reasons) == (score, action, reasons)


def test_p30_views(spark):
    df = spark.createDataFrame([(1, "INCLUDE_CORE", False, "", False), (2, "SATELLITE", True, "levered-assets", False), (3, "INCLUDE_QUALITY", False, "", True), (4, "AVOID", False, "levered-assets", True), (5, "WATCH", False, "", False), (6, "INCLUDE_VALUE", False, None, False)], "entity int, decision string, dual boolean, flag string, stress boolean")
    v = decisions.views(df)
    assert rows(v.orderBy("entity"), "entity", "view", "confidence") == [(1, 0.04, 0.6), (2, 0.02, 0.42), (3, 0.01, 0.225), (4, -0.004, 0.105), (6, 0.02, 0.4)]
    w = dict(rows(decisions.view_weights(v), "entity", "weight"))
    assert math.isclose(w[1], 0.024 / (0.024 + 0.0084 + 0.00225 + 0.008)) and w[4] == 0


def test_p31_labels(spark):
    cases = [(3.1, 0.6, "BULL", "BULL*"), (3.1, 0.59, "BULL", "BULL"), (3.0, 0.9, "NEUTRAL", "NEUTRAL"), (-3.1, 0.4, "BEAR", "BEAR*"), (-3.1, 0.41, "BEAR", "BEAR"), (5.0, None, "BULL", "BULL")]
    df = spark.createDataFrame([c[:2] for c in cases], "p double, b double")
    label, gated = decisions.forecast_label(F.col("p"), F.col("b"))
    assert rows(df, label, gated) == [c[2:] for c in cases]


def test_p32_ratios(spark):
    names = "price shares equity assets debt cash invested ttm_ni ttm_oi ttm_da ttm_int tax_rate".split()
    base = dict(price=10.0, shares=20.0, equity=100.0, assets=400.0, debt=50.0, cash=30.0, invested=None, ttm_ni=15.0, ttm_oi=25.0, ttm_da=5.0, ttm_int=4.0, tax_rate=0.2)
    out = ["market_cap", "roe", "roic", "de", "ev_ebitda", "pb", "mca", "coverage"]

    def one(**changes):
        df = spark.createDataFrame([tuple((base | changes)[n] for n in names)], ", ".join(f"{n} double" for n in names))
        return [None if x is None else round(x, 9) for x in rows(decisions.ratios(df), *out)[0]]

    assert one() == [200.0, 0.15, round(20 / 150, 9), 0.5, round(220 / 30, 9), 2.0, 0.5, 6.25]
    assert one(invested=80.0, tax_rate=None)[2] == round(18.75 / 80, 9)
    assert one(ttm_oi=0.0)[2] == round((15 + 4 * 0.8) / 150, 9) and one(ttm_oi=0.0)[7] is None and one(ttm_oi=0.0)[4] == 44.0
    assert one(equity=0.0)[1:4:2] == [None, None] and one(debt=0.0)[3] is None and one(debt=0.0)[4] == round(170 / 30, 9)
    assert one(shares=None)[0] is None and one(cash=None)[4] is None and one(ttm_da=None)[4] == round(220 / 25, 9)


def test_p34_strength_and_tier(spark):
    df = spark.createDataFrame([(1, 0.175, 0.2, 0.5, 5.0, 1.0, 0.3, 0.5, 3.5), (2, 0.3, None, 0.5, 20.0, 1.0, 0.3, 0.5, 1.0), (3, None, None, None, None, None, None, None, None), (4, 0.2, 0.2, 0.5, 5.0, 1.0, 0.3, 0.5, 2.0), (5, 0.2, 0.2, 0.5, 50.0, 1.0, 0.3, 0.5, 9.0)], RATIOS)
    got = rows(decisions.membership(df, F.col("roe") * 100, 18.0, F.when(F.col("entity") != 5, F.lit("s"))).orderBy("entity"), "strength", "tier", "eligible")
    # 1: 0.2 x 0.5 + 0.2 x 1 + 0.1 x 0.5, over all weights; 2: 0.2 over 0.8; parts where lower is better give nothing
    assert got == [(0.35, "dual_strong", False), (0.25, "neither", True), (0.0, "neither", False), (round(0.2 * 2 / 3 + 0.2 + 0.1 * 0.2, 4), "dual_weak", True), (round(0.2 * 2 / 3 + 0.2 + 0.1, 4), "quality_only", False)]


def test_j08_plan_and_a50_cap(spark):
    df = spark.createDataFrame([("high_vol_stress",), ("low_vol",), (None,)], "regime string")
    assert rows(regimes.rebalance_plan(df), "regime", "action", "turnover_band") == [("high_vol_stress", "reduced_rebalance", 0.5), ("low_vol", "full_rebalance", 1.0), ("normal", "full_rebalance", 1.0)]
    w = spark.createDataFrame([("g", 0.7, 0.4), ("g", 0.3, 0.6)], "g string, t double, c double")
    got = rows(risk.turnover_cap(w, ["g"], "t", "c", 0.5, "k"), "k")
    assert sorted(round(x, 9) for (x,) in got) == sorted([round(0.6 / 0.9, 9), round(0.3 / 0.9, 9)])
    assert rows(risk.turnover_cap(w, ["g"], "t", "c", 1.0, "k"), "k") == [(0.7,), (0.3,)]


def test_a29_to_a31_trends(spark):
    series = {"up": [1.0, 2.0, 3.0, 4.0], "turn": [4.0, 1.0, 5.0, 1.0, 5.0, 0.5], "gap": [2.0, None, 4.0, 6.0, 8.0], "few": [1.0, 2.0, 3.0]}
    df = spark.createDataFrame([(e, i, v) for e, s in series.items() for i, v in enumerate(s)], "e string, t int, x double")
    got = {r.e: r for r in peers.trend_flags(peers.trends(df, "e", "t", ["x"])).collect()}
    assert set(got) == {"up", "turn", "gap"}
    assert math.isclose(got["up"].slope, 4 / 3) and math.isclose(got["up"].change, 4.0) and math.isclose(got["up"].relative, 4.0) and math.isclose(got["up"].shift, (3.5 - 1.5) / 1.5) and got["up"].strong
    # gap keeps its place: rows 0, 2, 3, 4
    x, y = [0, 2, 3, 4], [2, 4, 6, 8]
    cov = sum((a - 2.25) * (b - 5) for a, b in zip(x, y)) / 3
    assert math.isclose(got["gap"].slope, cov / (sum((a - 2.25) ** 2 for a in x) / 4), rel_tol=1e-9) and math.isclose(got["gap"].change, got["gap"].slope * 4)
    assert got["turn"].slope < 0 and math.isclose(got["turn"].shift, (2.75 - 2.5) / 2.5) and got["turn"].recovering and not got["turn"].strong
    flags = spark.createDataFrame([("a", True, False, True), ("a", True, False, True), ("a", False, True, True), ("b", False, True, False), ("b", False, True, True)], "e string, recovering boolean, deteriorating boolean, strong boolean")
    ranks = spark.createDataFrame([("a", "g", 0.1, 0.2, 0.8), ("a", "h", 0.9, 0.2, 0.7), ("b", "g", 0.1, 0.1, 0.25)], "e string, group string, ret_rank double, vol_rank double, ratio_rank double")
    betas = spark.createDataFrame([("a", 1.2, 0.1, True, False), ("a", 0.8, -0.1, False, True), ("b", 0.5, -0.2, False, True)], "e string, beta double, off_median double, high boolean, low boolean")
    out = peers.assembled_signals(spark.createDataFrame([("a",), ("b",), ("c",)], "e string"), "e", flags, ranks, betas).orderBy("e")
    assert rows(out, "recovering", "deteriorating", "strong", "best_group", "fundamental_signal", "peer_signal", "beta_signal") == [(2, 1, 3, "g", "RECOVERING", "PEER_LEADER", "HIGH_BETA"), (0, 2, 1, "g", "DETERIORATING", "PEER_LAGGARD", "LOW_BETA"), (0, 0, 0, None, "NEUTRAL", "PEER_AVERAGE", "NEUTRAL_BETA")]


def test_a33_catalyst_and_a36_composite(spark):
    df = spark.createDataFrame([(1, 0.05, 0.9), (2, 0.01, None), (3, None, 0.2)], "e int, x double, m double")
    assert [(r.e, round(r.score, 9), r.momentum_flag) for r in peers.catalyst(df, "x", "m").orderBy("e").collect()] == [(1, 0.7 * 1 + 0.3 * 1, "hot"), (2, round(0.7 * 0.5 + 0.3 * 0.5, 9), None), (3, 0.0, "cold")]
    scores = spark.createDataFrame([(1, 3.0, None, 1.0), (2, 2.0, 5.0, 9.0), (3, 1.0, 7.0, 5.0)], "e int, p double, q double, r double")
    weights = spark.createDataFrame([("p", 0.6), ("q", 0.2), ("r", 0.0)], "family string, weight double")
    got = rows(peers.family_composite(scores, "e", ["p", "q", "r"], weights).orderBy("e"), "e", "composite", "rank")
    assert got == [(1, round((0.6 + 0.2 * 0.5) / 0.8, 4), 1), (2, round((0.6 * 2 / 3 + 0.2 * 0.5) / 0.8, 4), 2), (3, round((0.6 / 3 + 0.2) / 0.8, 4), 3)]
    assert {r.composite for r in peers.family_composite(scores, "e", ["p"], weights.where("false")).collect()} == {None}
    assert rows(spark.createDataFrame([(-0.1,), (0.0,), (4.9,), (5.0,), (None,)], "x double"), peers.surprise_bucket(F.col("x"))) == [("miss",), ("beat",), ("beat",), ("big_beat",), (None,)]


def test_a51_crisis_blend(spark):
    m = spark.createDataFrame([("a", "a", 4.0), ("b", "b", 1.0), ("c", "c", 1.0), ("a", "b", 0.4), ("a", "c", 0.0), ("b", "c", 0.7)], "a string, b string, s double")
    # correlations 0.2, 0 and 0.7, mean 0.3: all rise by 0.1
    got = {(r.a, r.b): (round(r.hard, 9), round(r.calm, 9)) for r in pairs.crisis_blend(m, {"hard": True, "calm": False}).collect()}
    assert got == {("a", "a"): (4.0, 4.0), ("b", "b"): (1.0, 1.0), ("c", "c"): (1.0, 1.0), ("a", "b"): (0.5, 0.42), ("a", "c"): (0.1, 0.02), ("b", "c"): (0.75, 0.71)}


def test_a62_buckets_and_a67_tiers(spark):
    df = spark.createDataFrame([(i, float(i), 0.1 if i != 2 else 1.3) for i in range(1, 10)], "e int, vol double, gap_share double")
    got = dict(rows(risk.barbell(df), "e", "bucket"))
    assert got == {1: "safe", 2: "convex", 3: "safe", 4: "middle", 5: "middle", 6: "middle", 7: "middle", 8: "convex", 9: "convex"}
    assert rows(spark.createDataFrame([(0.45,), (0.46,), (0.55,), (0.56,), (None,)], "x double"), risk.reliability_tier(F.col("x"))) == [("weak",), ("mixed",), ("mixed",), ("strong",), (None,)]


def test_a80_entropy_and_label(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0],), ([1 / 3, 1 / 3, 1 / 3],), ([0.7, 0.2, 0.1],), ([0.5, 0.5, 0.0],)], "p array<double>")
    h = [r[0] for r in rows(df, regimes.entropy(F.col("p")))]
    assert h[0] < 1e-9 and math.isclose(h[1], 1.0) and math.isclose(h[3], math.log(2) / math.log(3), rel_tol=1e-9)
    assert rows(df, regimes.soft_label(F.col("p"), ["x", "y", "z"])) == [("x",), ("uncertain",), ("x",), ("uncertain",)]
    bins = spark.createDataFrame([(0.0,), (0.3,), (0.31,), (0.6,), (0.9,)], "h double")
    assert rows(bins, regimes.entropy_bin(F.col("h"))) == [(None,), ("low",), ("mid",), ("mid",), ("high",)]


def test_a83_option_measures(spark):
    chain = [("e", "call", 90.0, 0.4, 10.0, 100.0), ("e", "call", 98.0, 0.30, 1.0, 100.0), ("e", "call", 104.0, 0.20, 1.0, 100.0), ("e", "call", 110.0, 0.15, 3.0, 100.0), ("e", "call", 100.0, 0.05, 99.0, 100.0), ("e", "put", 90.0, 0.9, 5.0, 100.0), ("e", "put", 100.0, 0.04, 99.0, 100.0), ("f", "put", 90.0, 0.5, 5.0, 100.0)]
    r = backtest.option_measures(spark.createDataFrame(chain, "k string, side string, strike double, iv double, vol double, spot double"), ["k"], "side", "strike", "iv", "vol", "spot").collect()
    assert [(x.k, round(x.atm, 9), round(x.skew, 9), round(x.put_call, 9)) for x in r] == [("e", 0.25, 0.25, round(5 / 15, 9))]


def test_w13_w28_w40(spark):
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(i)
    p = [10.0, 11.0, 12.0, 9.0, 15.0, 14.0, 13.0, 12.5, 16.0, 18.0]
    df = spark.createDataFrame([("a", day(i), x) for i, x in enumerate(p)] + [("b", day(i), 1.0 + i) for i in range(3)], "e string, t date, p double")
    r = windows.recent_percentile(df, "e", "t", "p", 2, 5, 8).collect()
    rolls = [p[i] / p[i - 2] - 1 for i in range(2, 10)][-5:]
    assert [(x.e, x.n) for x in r] == [("a", 5)] and math.isclose(r[0].now, rolls[-1]) and math.isclose(r[0].pctile, sum(x < rolls[-1] for x in rolls) / 5)
    f = {(x.e, x.h): x.forecast for x in backtest.drift_seasonal(df, "e", "t", "p", [1, 2, 5]).collect()}
    drift = (18.0 - 10.0) / 9
    assert math.isclose(f["a", 1], 0.6 * (18 + drift) + 0.4 * p[-9]) and math.isclose(f["a", 2], 0.6 * (18 + 2 * drift) + 0.4 * p[-8]) and math.isclose(f["a", 5], 0.6 * (18 + 5 * drift) + 0.4 * p[-10])
    assert f["b", 1] == f["b", 5] == 3.0
    r = [0.01, -0.02, 0.03, 0.0, 0.02, -0.01]
    t = windows.term_structure(spark.createDataFrame([("m", day(i), x) for i, x in enumerate(r)], "e string, t date, r double"), "e", "t", "r", [2, 3, 4], 2, 3, 4).orderBy("t").collect()[-1]
    sd = lambda v: 100 * math.sqrt(252 * sum((x - sum(v) / len(v)) ** 2 for x in v) / (len(v) - 1))
    two, three, four = sd(r[-2:]), sd(r[-3:]), sd(r[-4:])
    assert math.isclose(t.slope_long, four - three) and math.isclose(t.slope_short, three - two) and math.isclose(t.convexity, (two + four) / 2 - three) and t.contango == (four > three) and t.backwardation == (four < three)


@pytest.mark.parametrize(("series", "published"), [(1, {0.01: -3.43, 0.05: -2.86, 0.10: -2.57}), (2, {0.01: -3.90, 0.05: -3.34, 0.10: -3.05}), (3, {0.01: -4.29, 0.05: -3.74, 0.10: -3.45})])
def test_unit_root_p_meets_published_critical_values(spark, series, published):
    for p, t in published.items():
        assert abs(spark.range(1).select(C.unit_root_p(F.lit(t), series)).first()[0] - p) < 0.002
    grid = [r[0] for r in spark.range(0, 220).select(C.unit_root_p(F.col("id") / 10 - 20, series)).collect()]
    assert grid[0] < 1e-9 and all(a <= b + 1e-3 for a, b in zip(grid, grid[1:])) and rows(spark.range(1), C.unit_root_p(F.lit(5.0), series)) == [(1.0,)]


def test_a84_lexicon_of_any_size(spark):
    docs = spark.createDataFrame([(1, "Good <b>good</b> bad thing"), (2, None), (3, ""), (4, "<i>x</i> 123")], "d int, t string")
    lexicon = spark.createDataFrame([("good", 1), ("bad", -1), ("neutral", 0)], "word string, weight int")
    assert rows(backtest.lexicon_scores(docs, "d", "t", lexicon).orderBy("d"), "d", "words", "positive", "negative", "score") == [(1, 4, 2, 1, 250.0), (2, 0, 0, 0, 0.0), (3, 0, 0, 0, 0.0), (4, 1, 0, 0, 0.0)]
    big = spark.range(0, 200_000).selectExpr("translate(cast(id AS string), '0123456789', 'abcdefghij') AS word", "IF(id % 2 = 0, 1, -1) AS weight")
    text = spark.createDataFrame([(1, "a b c bcd bcde zzz")], "d int, t string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(backtest.lexicon_scores(text, "d", "t", big), "words", "positive", "negative") == [(6, 3, 2)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_s15_json_facts(spark):
    one = '{"facts": {"gaap": {"Rev": {"label": "x", "units": {"USD": [{"end": "2024-03-31", "val": 5, "frame": "CY2024Q1", "filed": "2024-05-01"}, {"end": "2024-03-31", "val": 6.5, "frame": "CY2024Q1", "filed": "2024-06-01"}, {"end": "2024-12-31", "val": 9, "frame": "CY2024", "filed": "2025-02-01"}], "pure": [{"end": "2024-06-30", "val": "7", "frame": "CY2024Q2I"}]}}}, "own": {"Odd": {"units": {"boxes": [{"val": true}, 3]}}, "Empty": {"units": {}}, "None": {}}}}'
    df = spark.createDataFrame([("a", one), ("b", "not json"), ("c", "{}"), ("d", None), ("e", '{"facts": 3}'), ("f", '{"facts": {"t": []}}')], "k string, j string")
    got = src.fact_rows(df, "k", "j")
    d = datetime.date
    assert sorted(rows(got, "entity", "taxonomy", "tag", "unit", "end", "val", "frame"), key=str) == sorted([
        ("a", "gaap", "Rev", "USD", d(2024, 3, 31), 5.0, "CY2024Q1"), ("a", "gaap", "Rev", "USD", d(2024, 3, 31), 6.5, "CY2024Q1"), ("a", "gaap", "Rev", "USD", d(2024, 12, 31), 9.0, "CY2024"),
        ("a", "gaap", "Rev", "pure", d(2024, 6, 30), 7.0, "CY2024Q2I"), ("a", "own", "Odd", "boxes", None, 1.0, None), ("a", "own", "Odd", "boxes", None, None, None),
    ], key=str)
    assert sorted(rows(src.single_quarters(got), "unit", "end", "val")) == [("USD", d(2024, 3, 31), 6.5), ("pure", d(2024, 6, 30), 7.0)]
