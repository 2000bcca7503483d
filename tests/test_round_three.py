"""Findings of round 3: registered queries against their SQL on small tables made for the case."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera import registry
from tessera.functions.columns import unit_root_p
from tessera.operators import backtest, blocks, grouped, pairs, peers, spreads
from tessera.plans import common

D = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(400)]


def lines(prices):
    """lineitem rows of one unit each: a price for each supplier and month."""
    at = [(s, m, p) for s, series in prices.items() for m, p in enumerate(series) if p is not None]
    return pd.DataFrame({"l_orderkey": range(len(at)), "l_suppkey": [a[0] for a in at], "l_shipdate": [pd.Timestamp("1994-01-15") + pd.DateOffset(months=a[1]) for a in at], "l_quantity": 1.0, "l_extendedprice": [float(a[2]) for a in at]}).astype({"l_shipdate": "datetime64[us]"})


def tables(path, nations, **frames):
    """The folder with supplier (supplier -> nation), nation (two regions) and the frames given."""
    frames["supplier"] = pd.DataFrame({"s_suppkey": list(nations), "s_nationkey": list(nations.values())})
    frames["nation"] = pd.DataFrame({"n_nationkey": range(4), "n_regionkey": [0, 0, 1, 1], "n_name": list("abcd")})
    for name, f in frames.items():
        f.to_parquet(path / f"{name}.parquet")
    return str(path)


def both(spark, name, d):
    """Rows of the query and of its SQL."""
    got = entry.queries()[name](spark, d)
    con = duckdb.connect()
    for t in ("lineitem", "orders", "supplier", "nation"):
        try:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
        except duckdb.IOException:
            continue
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=str), sorted(want, key=str)


def test_a_basket_without_a_drawdown_has_an_infinite_ratio(spark, tmp_path):
    rising = {s: [100 * (1 + 0.01 * s) ** m * (1 + 0.001 * (m % 3)) for m in range(30)] for s in (2, 3)}
    d = tables(tmp_path, {2: 0, 3: 2, 4: 2}, lineitem=lines(rising | {4: [100 - m for m in range(30)]}))
    got, want = both(spark, "a12_index_backtest", d)
    assert got == want and float("inf") in {r[5] for r in got}


def test_equal_means_of_a_ratio_of_counts_make_no_shift(spark, tmp_path):
    rows = [(c, q) for c, counts in enumerate([(1, 4, 2, 3), (1, 5, 3, 3), (1, 6, 5, 2), (1, 1, 2, 5)]) for q, n in enumerate(counts) for _ in range(n)]
    o = pd.DataFrame({"o_orderkey": range(len(rows)), "o_custkey": [r[0] for r in rows], "o_totalprice": [1000.0 + 17 * k for k in range(len(rows))], "o_orderdate": [pd.Timestamp("1994-01-05") + pd.DateOffset(months=3 * r[1]) for r in rows]}).astype({"o_orderdate": "datetime64[us]"})
    got, want = both(spark, "a30_trend_flags", tables(tmp_path, {1: 0}, orders=o))
    assert got == want and len(got) == 28  # no customer has four values of roic


def test_short_series_have_all_folds(spark, tmp_path):
    got, want = both(spark, "w44_purged_folds", tables(tmp_path, {1: 0}, lineitem=lines({1: range(100, 110), 2: range(100, 190)})))
    assert got == want and len(got) == 4 * 100


def test_betas_equal_but_for_their_last_bits_lie_on_the_quartile(spark):
    v = np.random.default_rng(3).normal(size=200)
    rolled = spark.createDataFrame([(int(g), e, 1, float(v[g] * (1 + 2e-16 * e))) for g in range(200) for e in range(7)], "g int, e int, t int, beta double")
    assert peers.average_rolling_beta(rolled, "e", "g", "beta", "t", 20).where("high OR low").count() == 0


def panel(spark, series=9, days=70, seed=5):
    """Random walks of some series in two groups, with gaps."""
    g = np.random.default_rng(seed)
    walk = np.exp(np.cumsum(g.normal(0, 0.1, (series, days)), 1)) * 100
    rows = [(s, "uv"[s % 2], D[t], float(walk[s, t])) for s in range(series) for t in range(days) if g.random() > 0.1]
    return spark.createDataFrame(rows, "entity int, sector string, date date, price double")


IN = ("entity", "date", "v", ["sector"])


def same(got, want, keys):
    g, w = (f.toPandas().sort_values(keys).reset_index(drop=True) for f in (got, want))
    assert len(g) == len(w) > 0
    pd.testing.assert_frame_equal(g, w[list(g.columns)], check_dtype=False, rtol=1e-9, atol=1e-9)


def test_filtered_correlations_of_blocks_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_SERIES", 2)
    p = panel(spark).withColumn("v", F.col("price") / 100 - 1)
    rows = p.toPandas()
    by = {e: g.set_index("date").v for e, g in rows.groupby("entity")}
    group = rows.groupby("entity").sector.first()
    want = []
    for a in by:
        for b in by:
            if a < b and group[a] == group[b]:
                both_ = pd.concat([by[a], by[b]], axis=1, join="inner").sort_index()
                m, var = 0.0, 1.0
                for k, (day, (x, y)) in enumerate(zip(both_.index, both_.to_numpy(), strict=True)):
                    if k >= 5:
                        last = both_.to_numpy()[max(0, k - 19) : k + 1]
                        z = min(max(x * y / ((last[:, 0].std() + 1e-12) * (last[:, 1].std() + 1e-12)), -3), 3)
                        var += 1e-4
                        gain = var / (var + 0.05)
                        m, var = m + gain * (z - m), var * (1 - gain)
                    want.append((group[a], int(a), int(b), day, float(min(max(m, -1.0), 1.0)) if k >= 5 else None))
    got = blocks.filtered_correlation(p, *IN)
    same(got, spark.createDataFrame(want, "sector string, a int, b int, date date, corr double"), ["a", "b", "date"])


def test_lead_lag_of_blocks_equals_that_of_rows_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_SERIES", 2)
    p = panel(spark).withColumn("v", F.col("price"))
    same(blocks.lead_lag(p, *IN), grouped.lead_lag(pairs.paired(p, *IN), ["sector", "a", "b"], "date"), ["a", "b"])


def _folds(p):
    return backtest.fold_dates(p, "date", folds=2, lookback=30, test=15)


RULE = spreads.Rule(least=10, entry=0.8, hold=6)


def _rows_of_spreads(p):
    """The same spreads with a row for each pair and date."""
    x = pairs.paired(p, *IN).join(_folds(p), "date")
    fit = pairs.pair_stats(x.where("train"), ["fold"], 10).select("fold", "a", "b", "beta")
    s = x.join(fit, ["fold", "a", "b"]).withColumn("s", F.col("y") - F.col("beta") * F.col("x"))
    base = s.where("train").groupBy("fold", "a", "b").agg(F.avg("s").alias("mu"), F.stddev_samp("s").alias("sd"))
    return s.join(base, ["fold", "a", "b"]).withColumns({"z": (F.col("s") - F.col("mu")) / F.col("sd"), "px": F.exp("x"), "py": F.exp("y")})


def test_trades_of_blocks_equal_those_of_rows_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_SERIES", 2)
    p = panel(spark).withColumn("v", F.log("price"))
    want = grouped.pair_trades(_rows_of_spreads(p).where("NOT train"), ["fold", "a", "b"], "date", "z", entry=0.8, hold=6, prices=("px", "py", "beta"))
    got = spreads.trades(p, *IN, _folds(p), RULE).drop("sector")
    same(got, want, ["fold", "a", "b", "entry_date"])
    total = want.groupBy("a", "b").agg(F.count(F.lit(1)).alias("trades"), F.avg((F.col("hedged_pnl") > 0).cast("double")).alias("win_rate"), F.avg("hedged_pnl").alias("mean"), F.sum("hedged_pnl").alias("total"), (F.try_divide(F.avg("hedged_pnl"), F.stddev_pop("hedged_pnl")) * F.sqrt(252 / F.avg("bars_held"))).alias("sharpe"))
    same(spreads.summary(p, *IN, _folds(p), RULE).drop("sector"), total, ["a", "b"])


def test_chosen_pairs_of_blocks_equal_those_of_rows_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_SERIES", 2)
    p = panel(spark, 16).withColumn("v", F.log("price"))
    s = _rows_of_spreads(p)
    fit = pairs.half_life(s.where("train"), ["fold", "a", "b"], "date", "s").withColumn("p", unit_root_p(-F.col("t"))).where("p IS NOT NULL").toPandas()
    chosen = []
    for _, g in fit.groupby("fold"):
        g = g.sort_values("p").reset_index(drop=True)
        k = max([i + 1 for i in g.index if g.p[i] <= 0.5 * (i + 1) / len(g)], default=0)
        chosen.append(g[: k][g[:k].half_life.between(0.5, 24)])
    chosen = pd.concat(chosen)
    t = grouped.pair_trades(s.where("NOT train"), ["fold", "a", "b"], "date", "z", entry=0.8, hold=6, prices=("px", "py", "beta"))
    net = F.col("hedged_pnl") - 0.001 - 0.0025 * F.col("bars_held") / 252
    want = t.join(spark.createDataFrame(chosen[["fold", "a", "b"]]), ["fold", "a", "b"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("trades"), F.count_distinct("fold").alias("folds"), F.avg((net > 0).cast("double")).alias("win_rate"), F.sum(net).alias("net"))
    limits = pairs.step_up_limits(spreads.tests(p, *IN, _folds(p), RULE), "p", 0.5, ["fold"])
    got = spreads.chosen_trades(p, *IN, _folds(p), RULE, {r.fold: r.limit for r in limits.collect()}, (0.5, 24.0), 0.001, 0.0025)
    same(got.drop("sector"), want, ["a", "b"])


def test_copies_of_a_series_have_no_spread(spark):
    p = panel(spark, 2).withColumn("v", F.log("price")).where("entity = 0")
    twice = p.unionByName(p.withColumns({"entity": F.lit(7), "v": 3 * F.col("v") + 1}))
    assert spreads.trades(twice, *IN, _folds(p), RULE).count() == 0


def test_no_rows_of_pairs_and_dates_are_shuffled(spark, tmp_path):
    d = tables(tmp_path, {1: 0, 2: 0, 3: 0}, lineitem=lines({s: [100 + (7 * s * m) % 13 for m in range(60)] for s in (1, 2, 3)}))
    for name in ("w37_filtered_correlation", "a81_lead_lag", "a70_pair_summary", "w47_pair_trades", "w48_walk_forward_pairs"):
        plan = entry.queries()[name](spark, d)._jdf.queryExecution().toString()
        assert "FlatMapGroupsInArrow" in plan and "Join" not in plan.split("FlatMapGroupsInArrow")[0], name


@pytest.mark.parametrize("name", ["a63_fragility", "p29_decision_points"])
def test_steps_of_one_query_read_one_table_of_bars(spark, monkeypatch, name):
    made, keep = [], common.registry.table
    monkeypatch.setattr(common.registry, "table", lambda s, d, n: made.append(n) or keep(s, d, n))
    registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert (made.count("lineitem"), made.count("orders")) == (1, 1)
    assert common._written.get() is None
