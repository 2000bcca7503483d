"""Findings of round 4: kernels over tiles of series with the same dates against loops over pairs."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import blocks, grouped, pairs, spreads

D = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(400)]
IN = ("entity", "date", "r", ["sector"])


@pytest.fixture(scope="module")
def values():
    """Series of one group: some share all dates, some miss one date each, some a few; one is constant, two are copies."""
    g = np.random.default_rng(4)
    v = g.normal(0, 0.1, (18, 60)) + 0.5 * g.normal(0, 0.1, 60)
    v[5] = 0.25
    v[9] = v[8]
    for s in range(10, 14):
        v[s, 2 * s] = np.nan  # as many dates each, but others
    v[14:][g.random((4, 60)) < 0.2] = np.nan
    return v


@pytest.fixture(scope="module")
def panel(spark, values):
    rows = [(s, "u", D[t], float(v)) for (s, t), v in np.ndenumerate(values) if not np.isnan(v)]
    return spark.createDataFrame(rows, "entity int, sector string, date date, r double").cache()


@pytest.fixture(params=[(512, 4), (4, 2), (512, 1), (512, 1000)])
def sized(request, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_SERIES", request.param[0])
    monkeypatch.setattr(blocks, "TILE_SERIES", request.param[1])


def both(values):
    """Names, dates and values of all pairs over their common dates."""
    for a in range(len(values)):
        for b in range(a + 1, len(values)):
            at = np.flatnonzero(~np.isnan(values[a]) & ~np.isnan(values[b]))
            yield a, b, at, values[a, at], values[b, at]


@pytest.mark.parametrize("part", [1 << 19, 200])
def test_filtered_correlations_of_partners_that_miss_other_dates_equal_a_loop(panel, values, sized, monkeypatch, part):
    monkeypatch.setattr(blocks, "PART_VALUES", part)
    want = {}
    for a, b, at, x, y in both(values):
        m, p = 0.0, 1.0
        for t in range(len(at)):
            sx, sy = x[max(t - 19, 0) : t + 1].std(), y[max(t - 19, 0) : t + 1].std()
            z = min(max(x[t] * y[t] / ((sx + 1e-12) * (sy + 1e-12)), -3.0), 3.0)
            if t >= 5:
                p += 1e-4
                gain = p / (p + 0.05)
                m += gain * (z - m)
                p *= 1 - gain
            want[a, b, D[at[t]]] = min(max(m, -1.0), 1.0) if t >= 5 else None
    got = {(r.a, r.b, r.date): r["corr"] for r in blocks.filtered_correlation(panel, *IN).collect()}
    assert set(got) == set(want)
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)


def rows_of(values, make, module=blocks):
    """The rows that the kernel of an operator makes of series as one block with itself and as two halves, in this process."""
    held = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(module, "over_blocks", lambda panel, entity, time, x, by, kernel, *rest: held.append(kernel))
        make()
    name, at = np.arange(len(values)) * 3, np.array(D[: values.shape[1]], "datetime64[D]")
    name = np.random.default_rng(1).permutation(name)
    half = len(name) // 2
    pair = lambda p, q: blocks.BlockPair(name[p], name[q], at, values[p], values[q], name[p][:, None] < name[q][None, :] if p == q else np.ones((len(name[p]), len(name[q])), bool))
    for block in (pair(slice(None, half), slice(None, half)), pair(slice(None, half), slice(half, None)), pair(slice(half, None), slice(half, None))):
        for rows in held[0](block):
            plain = {c: v.to_pylist() if hasattr(v, "to_pylist") else v.tolist() for c, v in rows.items()}
            yield from (dict(zip(plain, r, strict=True)) for r in zip(*plain.values(), strict=True))


def _f(x, y, lag):
    """F statistic of x's lags by least squares."""
    n = len(y) - lag
    lags = lambda v: [v[lag - k - 1 : len(v) - k - 1] for k in range(lag)]
    rest = []
    for columns in ([np.ones(n), *lags(y)], [np.ones(n), *lags(y), *lags(x)]):
        m = np.column_stack(columns)
        rest.append(((y[lag:] - m @ np.linalg.lstsq(m, y[lag:])[0]) ** 2).sum())
    return (rest[0] - rest[1]) / lag / (rest[1] / (n - 2 * lag - 1))


@pytest.mark.parametrize("lag, tile", [(2, 4), (2, 1), (2, 1000), (1, 4), (3, 1)])
def test_lead_lag_fits_of_tiles_equal_least_squares(spark, panel, values, monkeypatch, lag, tile):
    v = values.copy()
    v[1, 1:] = v[0, :-1]  # follows the other one to the last digit
    v[2] = 3 * v[3] + 1e-6 * v[2]
    name = np.random.default_rng(1).permutation(np.arange(len(v)) * 3)
    monkeypatch.setattr(blocks, "TILE_SERIES", tile)
    got = {(r["a"], r["b"]): r for r in rows_of(v, lambda: blocks.lead_lag(panel, *IN, lag=lag))}
    of = {n: k for k, n in enumerate(name)}
    assert len(got) == len(v) * (len(v) - 1) // 2
    for (a, b), r in got.items():
        x, y = v[of[a]], v[of[b]]
        at = ~np.isnan(x) & ~np.isnan(y)
        want = grouped.lead_lag_f(grouped.Layout(np.array([at.sum()])), x[at], y[at], lag)[0]
        assert a < b and r["n"] == at.sum() - lag
        assert r["f"] == pytest.approx(want, rel=1e-5, abs=1e-6, nan_ok=True), (of[a], of[b])
        if min(of[a], of[b]) > 5 and (of[a], of[b]) not in ((8, 9), (9, 8)):
            assert r["f"] == pytest.approx(_f(x[at], y[at], lag), rel=1e-6)


def test_pairs_that_share_their_dates_are_fitted_by_products(panel, values, monkeypatch):
    fits, keep = [], blocks.lead_lag_f
    v = np.random.default_rng(3).normal(0, 1, (60, 50))
    v[7] = v[8]
    monkeypatch.setattr(blocks, "lead_lag_f", lambda s, *rest: fits.extend(s.length) or keep(s, *rest))
    assert len(list(rows_of(v, lambda: blocks.lead_lag(panel, *IN)))) == 60 * 59 // 2
    assert len(fits) == 0


@pytest.mark.parametrize("tile, cells, alpha", [(4, 1 << 16, 0.1), (1, 7, 0.3), (1000, 64, 0.02)])
def test_step_up_over_pairs_is_that_of_ordered_values(spark, panel, values, monkeypatch, tile, cells, alpha):
    monkeypatch.setattr(blocks, "TILE_SERIES", tile)
    monkeypatch.setattr(pairs, "STEP_UP_CELLS", cells)
    want = {}
    for a, b, at, x, y in both(values):
        if len(at) >= 40 and 5 not in (a, b):
            c = np.corrcoef(x, y)[0, 1]
            t = abs(c) * math.sqrt((len(at) - 2) / max(1 - c * c, 1e-300))
            k = 1 / (1 + 0.2316419 * t)
            tail = 0.3989422804014327 * math.exp(-t * t / 2) * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
            want[a, b] = round(2 * tail, 9)
    p = sorted(want.values())
    best = max([k + 1 for k in range(len(p)) if p[k] <= alpha * (k + 1) / len(p)], default=0)
    got = {(r.a, r.b): r for r in blocks.step_up_pairs(panel, *IN, 40, alpha, 9).collect()}
    assert set(got) == set(want) and 0 < best < len(p)
    assert all(abs(got[k].p - want[k]) < 2e-9 and got[k].survives == (want[k] <= alpha * best / len(p)) for k in want)


def test_no_p_value_of_a_pair_is_counted_outside_the_blocks(spark, panel, monkeypatch):
    kernels, keep = [], blocks.run_blocks
    monkeypatch.setattr(blocks, "run_blocks", lambda dealt, kernel, fields, *rest: kernels.append([f.name for f in fields]) or keep(dealt, kernel, fields, *rest))
    blocks.step_up_pairs(panel, *IN, 20, 0.1, 9)
    assert kernels[0] == ["_family", "_cell", "_c"] and kernels[-1] == ["a", "b", "p", "survives"]
    made = pairs.step_up_limits
    monkeypatch.setattr(pairs, "step_up_limits", lambda *a, **k: pytest.fail("rows of all pairs") or made(*a, **k))
    entry.queries()["a69_step_up_filter"](spark, "/root/testdata/sf0.001")


RULE = spreads.Rule(least=10, entry=0.8, hold=6)


@pytest.fixture(scope="module")
def folds(spark):
    rows = [(D[t], f, t < 20 * f + 25) for f in range(2) for t in range(20 * f, 20 * f + 40)]
    return spark.createDataFrame(rows, "date date, fold int, train boolean")


def _sorted(rows, keys):
    return sorted(rows, key=lambda r: tuple(r[k] for k in keys))


def _alike(got, want, keys):
    assert len(got) == len(want) > 0
    for g, w in zip(_sorted(got, keys), _sorted(want, keys), strict=True):
        assert all(g[k] == (pytest.approx(w[k], rel=1e-7, abs=1e-9, nan_ok=True) if isinstance(w[k], float) else w[k]) for k in w), (g, w)


def _spread_values(values):
    v = np.cumsum(values, 1)
    v[5] = 4.0
    v[7] = 2 * v[6] + 1e-5 * values[7]
    return v


@pytest.mark.parametrize("make, keys", [(spreads.trades, ("fold", "a", "b", "entry_date")), (spreads.summary, ("a", "b"))])
@pytest.mark.parametrize("size", [1 << 14, 5])
def test_trades_of_tiles_are_those_of_single_pairs(spark, panel, folds, values, monkeypatch, make, keys, size):
    monkeypatch.setattr(spreads, "TILE_PAIRS", size)
    each = {}
    for tile in (1000, 4, 1):
        monkeypatch.setattr(blocks, "TILE_SERIES", tile)
        each[tile] = list(rows_of(_spread_values(values), lambda: make(panel, *IN, folds, RULE), spreads))
        assert not [r for r in each[tile] if r["a"] >= r["b"]]
    _alike(each[4], each[1000], keys)
    _alike(each[1], each[1000], keys)


def test_pairs_that_share_their_dates_make_no_rows_of_a_spread(spark, panel, folds, monkeypatch):
    monkeypatch.setattr(spreads, "_spread", lambda *a: pytest.fail("a spread of single pairs"))
    v = np.cumsum(np.random.default_rng(3).normal(0, 0.1, (60, 60)), 1)
    v[:30, 50:] = np.nan
    assert len(list(rows_of(v, lambda: spreads.summary(panel, *IN, folds, RULE), spreads))) > 1000
    assert len(list(rows_of(v, lambda: spreads.trades(panel, *IN, folds, RULE), spreads))) > 1000


@pytest.mark.parametrize("tile", [4, 1000])
def test_walk_forward_keeps_the_limits_of_all_p_values_and_writes_none_of_them(spark, values, folds, monkeypatch, tile):
    monkeypatch.setattr(blocks, "TILE_SERIES", tile)
    g = np.random.default_rng(8)
    v = np.cumsum(0.1 * g.normal(0, 1, 60)) + 0.05 * g.normal(0, 1, (18, 60))  # spreads that revert
    v[14:][np.isnan(values[14:])] = np.nan
    v[9] = v[8]
    p = spark.createDataFrame([(s, "u", D[t], float(x)) for (s, t), x in np.ndenumerate(v) if not np.isnan(x)], "entity int, sector string, date date, r double").cache()
    limits = {r.fold: r.limit for r in pairs.step_up_limits(spreads.tests(p, *IN, folds, RULE), "p", 0.2, ["fold"]).collect()}
    assert len(limits) == 2 and max(limits.values()) > 0
    want = spreads.chosen_trades(p, *IN, folds, RULE, limits, (0.1, 24.0), 0.001, 0.0025).toPandas().to_dict("records")
    written = []
    for module in (blocks, pairs, spreads):
        monkeypatch.setattr(module, "cut", lambda df, name="cut", keep=module.cut: written.append(name) or keep(df, name))
    got = spreads.walk_forward(p, *IN, folds, RULE, 0.2, (0.1, 24.0), 0.001, 0.0025).toPandas().to_dict("records")
    _alike(got, want, ("a", "b"))
    entry.queries()["w48_walk_forward_pairs"](spark, "/root/testdata/sf0.001")
    assert set(written) == {"series", "dealt", "cells"}


@pytest.mark.parametrize("name", ["w37_filtered_correlation", "a81_lead_lag", "a69_step_up_filter", "w48_walk_forward_pairs", "w47_pair_trades", "a70_pair_summary", "a43_correlation_stability"])
def test_no_expression_rounds_the_rows_of_pairs(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "InArrow" in plan and "round(" not in plan


def test_rolling_statistics_are_rounded_as_spark_rounds_them(panel):
    told = ("mean", "std", "span", "iqr", "positive")
    raw = {(r.a, r.b): r for r in blocks.rolling_by_pair(panel, *IN, 12).select("a", "b", *[F.round(c, 6).alias(c) for c in told]).collect()}
    got = {(r.a, r.b): r for r in blocks.rolling_by_pair(panel, *IN, 12, dict.fromkeys(told, 6)).select("a", "b", *told).collect()}
    assert got == raw and len(got) > 100
