"""Findings of round 3 on statistics of all pairs: results of blocks against loops, and what leaves their tasks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, pairs

D = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(400)]
IN = ("entity", "date", "r", ["sector"])


@pytest.fixture(scope="module")
def panel(spark):
    """Series of two groups: most of one group share their dates, some miss a few, one is constant and two are copies."""
    g = np.random.default_rng(7)
    value = g.normal(0, 0.1, (26, 50)) + 0.5 * g.normal(0, 0.1, 50)
    value[5] = 0.25
    value[9] = value[8]
    gone = (g.random(value.shape) < 0.1) & (np.arange(26) % 3 == 0)[:, None]
    rows = [(s, "uv"[s % 2], D[t], float(value[s, t])) for s in range(26) for t in range(50) if not gone[s, t]]
    return spark.createDataFrame(rows, "entity int, sector string, date date, r double").cache()


@pytest.fixture(params=[(512, 4), (4, 2), (512, 1), (512, 1000)])
def sized(request, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_SERIES", request.param[0])
    monkeypatch.setattr(blocks, "TILE_SERIES", request.param[1])


def same(got, want, keys):
    g, w = (f.toPandas().sort_values(keys).reset_index(drop=True) for f in (got, want))
    assert len(g) == len(w) > 0
    pd.testing.assert_frame_equal(g, w[list(g.columns)], check_dtype=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("held", [100_000, 3])
def test_quantiles_of_correlations_equal_percentile_without_rows_of_pairs(spark, panel, monkeypatch, held):
    monkeypatch.setattr(blocks, "CELL_VALUES", held)
    labels = panel.select("date").distinct().select("date", F.explode(F.array(F.lit("all"), F.when(F.dayofmonth("date") < 16, "first").otherwise("second"))).alias("label"))
    c = pairs.pair_stats(pairs.paired(panel, *IN).join(labels, "date"), ["label", "sector"], 20)
    want = c.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("corr").alias("pairs"), F.avg("corr").alias("mean"), F.percentile("corr", 0.25).alias("low"), F.percentile("corr", 0.999).alias("high"))
    same(blocks.corr_quantiles(panel, *IN, 20, labels, {"low": 0.25, "high": 0.999}), want, ["label"])


def test_tiles_and_rows_hold_every_pair_once(sized, panel):
    rows = panel.toPandas().pivot(index="entity", columns="date", values="r").to_numpy()
    a = np.arange(len(rows))
    block = blocks.BlockPair(a, a, np.arange(rows.shape[1]), rows, rows, a[:, None] < a[None, :])
    tiles, rest = block.tiles()
    seen = rest.astype(int)
    for i, j, columns in tiles:
        assert np.isfinite(rows[np.ix_(i, columns)]).all() and np.isfinite(rows[np.ix_(j, columns)]).all()
        assert len(columns) == (np.isfinite(rows[i[0]]) & np.isfinite(rows[j[0]])).sum()
        seen[np.ix_(i, j)] += block.wanted[np.ix_(i, j)]
    assert (seen == block.wanted).all()


def _rolled(panel, rows):
    return pairs.rolling_corr(pairs.paired(panel, *IN), ["sector"], "date", rows)


def test_rolling_statistics_of_tiles_equal_windows_of_rows_of_pairs(spark, panel, sized):
    c = _rolled(panel.where("entity NOT IN (5, 9)"), 9)
    by_time = c.groupBy("sector", "date").agg(F.count("corr").alias("n"), F.avg("corr").alias("mean_corr"), F.stddev_samp("corr").alias("std_corr"))
    same(blocks.rolling_by_time(panel.where("entity NOT IN (5, 9)"), *IN, [9]).drop("rows"), by_time, ["sector", "date"])
    c = _rolled(panel, 9).where("corr IS NOT NULL")
    by_pair = c.groupBy("sector", "a", "b").agg(F.count("corr").alias("n"), F.avg("corr").alias("mean"), F.stddev_samp("corr").alias("std"), (F.max("corr") - F.min("corr")).alias("span"), (F.percentile("corr", 0.75) - F.percentile("corr", 0.25)).alias("iqr"), F.avg((F.col("corr") > 0).cast("double")).alias("positive"))
    same(blocks.rolling_by_pair(panel, *IN, 9), by_pair, ["a", "b"])
    assert blocks.rolling_by_time(panel, *IN, [9]).agg(F.sum("n")).first()[0] == c.count()


@pytest.mark.parametrize("shared, values, rows", [(3, 600, 9), (9, 1 << 21, 9), (2, 1, 4)])
def test_rolling_sums_over_series_with_the_same_times_equal_windows_of_rows_of_pairs(spark, panel, monkeypatch, shared, values, rows):
    for name, value in {"BLOCK_SERIES": 4, "SHARED_SERIES": shared, "SHARED_CHUNK": 5, "TILE_VALUES": values}.items():
        monkeypatch.setattr(blocks, name, value)
    short = F.col("date") < F.lit(D[7])
    x = panel.where(~short | ~F.col("entity").isin(0, 1, 2, 4, 7)).where("entity NOT IN (5, 9)").where(short | ~F.col("entity").isin(10, 11, 13, 16))
    c = _rolled(x, rows)
    by_time = c.groupBy("sector", "date").agg(F.count("corr").alias("n"), F.avg("corr").alias("mean_corr"), F.stddev_samp("corr").alias("std_corr"))
    same(blocks.rolling_by_time(x, *IN, [rows]).drop("rows"), by_time, ["sector", "date"])
    assert blocks.rolling_by_time(panel, *IN, [9]).agg(F.sum("n")).first()[0] == _rolled(panel, 9).where("corr IS NOT NULL").count()


def test_series_with_the_same_times_are_in_no_block_pair(spark, panel, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_SERIES", 4)
    monkeypatch.setattr(blocks, "SHARED_SERIES", 3)
    dealt, keep = [], blocks.run_blocks
    monkeypatch.setattr(blocks, "run_blocks", lambda d, *rest: dealt.append(d) or keep(d, *rest))
    whole = panel.where("entity % 3 <> 0")
    assert blocks.rolling_by_time(whole, *IN, [9]).where("n > 0").count() > 0
    assert dealt[0].tasks == 1 and dealt[0].series.where("_own > 0").count() == 0


def test_tails_and_spreads_of_tiles_equal_those_of_rows_of_pairs(spark, panel, sized):
    p = pairs.paired(panel, *IN)
    same(blocks.tail_dependence(panel, *IN, 0.2, 20), pairs.tail_dependence(p, ["sector"], 0.2, 20), ["a", "b"])
    p = p.where("a <> 8 OR b <> 9")
    beta = pairs.pair_stats(p, ["sector"], 2).where("beta IS NOT NULL").select("sector", "a", "b", "beta")
    s = p.join(beta, ["sector", "a", "b"]).withColumn("s", F.col("y") - F.col("beta") * F.col("x"))
    want = pairs.half_life(s, ["sector", "a", "b"], "date", "s").join(beta, ["sector", "a", "b"])
    got = blocks.reversion(panel, *IN).where("a <> 8 OR b <> 9")
    same(got.select("a", "b", "beta", "rho", "t"), want.select("a", "b", "beta", "rho", "t"), ["a", "b"])


def test_peers_of_blocks_are_those_of_all_pairs(spark, panel, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_SERIES", 4)
    c = pairs.pair_stats(pairs.paired(panel, *IN), ["sector"], 20).withColumn("c", F.abs("corr"))
    s = c.select(F.col("a").alias("target"), F.col("b").alias("peer"), "c").unionByName(c.select(F.col("b").alias("target"), F.col("a").alias("peer"), "c")).toPandas()
    got = blocks.extreme_peers(panel, *IN, 20, 2).toPandas()
    assert len(got) < len(s)
    for t, g in s.fillna(-1.0).groupby("target"):
        mine = got[got.target == t].fillna({"c": -1.0})
        for up in (False, True):
            want = g.assign(c=g.c.round(9)).sort_values(["c", "peer"], ascending=[up, True]).peer.head(2)
            assert list(mine.assign(c=mine.c.round(9)).sort_values(["c", "peer"], ascending=[up, True]).peer.head(2)) == list(want)


@pytest.mark.parametrize("cells", [1, 7, 1 << 16])
def test_step_up_limits_of_cells_are_those_of_ordered_values(spark, monkeypatch, cells):
    monkeypatch.setattr(pairs, "STEP_UP_CELLS", cells)
    g = np.random.default_rng(2)
    rows = [(f, float(v)) for f, (n, a) in enumerate([(300, 0.3), (200, 1.0), (50, 8.0), (1, 0.1)]) for v in np.append(np.round(g.beta(a, 1.0, n), 3), [0.0, 1.0])]
    got = {r.f: r.limit for r in pairs.step_up_limits(spark.createDataFrame(rows, "f int, p double"), "p", 0.2, ["f"]).collect()}
    for f in range(4):
        p = np.sort([v for k, v in rows if k == f])
        k = max([i + 1 for i in range(len(p)) if p[i] <= 0.2 * (i + 1) / len(p)], default=0)
        assert got[f] == pytest.approx(0.2 * k / len(p), abs=1e-15)


def test_no_rows_of_tests_are_written(spark, panel, monkeypatch):
    written = []
    keep = pairs.cut
    monkeypatch.setattr(pairs, "cut", lambda df, name="cut": written.append(name) or keep(df, name))
    t = blocks.pair_stats(panel, *IN, 20).where("corr IS NOT NULL").select("a", "b", pairs.corr_p_value(F.col("corr"), F.col("n")).alias("p"))
    assert pairs.step_up(t, "p", 0.1).count() == t.count() and "tests" not in written
