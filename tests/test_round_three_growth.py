"""Findings of round 3 on figures that grow: what is left to expressions on rows of pairs, and what is shuffled."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera import registry
from tessera.functions import arrays
from tessera.functions import columns as C
from tessera.operators import asof, blocks
from tessera.plans import join_pair_queries

SF = "/root/testdata/sf0.001"
D = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(400)]
IN = ("entity", "date", "r", ["sector"])


def test_rounding_of_arrays_is_that_of_spark(spark):
    g = np.random.default_rng(1)
    v = np.concatenate([g.normal(0, 3, 2000), np.round(g.normal(0, 3, 2000), 7), np.arange(-50, 50) / 2e6, np.arange(-50, 50) / 2e8, g.normal(0, 1e10, 200), 10.0 ** np.arange(-20, 23), [0.0, -0.0, -1e-9, 1.0000005, 2.5000015, 1e300, 5e-324, np.inf, -np.inf, np.nan]])
    want = spark.createDataFrame(pd.DataFrame({"i": range(len(v)), "v": v})).select("i", F.round("v", 6).alias("six"), F.round("v", 8).alias("eight")).toPandas().sort_values("i")
    for name, digits in (("six", 6), ("eight", 8)):
        got = arrays.round_half_up(v, digits)
        assert [x.hex() for x in got] == [x.hex() for x in want[name]]


def test_p_values_and_half_lives_of_spreads_are_made_inside_their_blocks(spark):
    g = np.random.default_rng(3)
    value = g.normal(0, 1, (8, 60)).cumsum(1) * 0.1
    value[3] = value[2]
    rows = [(s, "uv"[s % 2], D[t], float(value[s, t])) for s in range(8) for t in range(60) if s != 4 or t % 7]
    panel = spark.createDataFrame(rows, "entity int, sector string, date date, r double")
    rho = F.col("rho")
    want = blocks.reversion(panel, *IN).select("a", "b", "p_value", "half_life", C.unit_root_p(-F.col("t")).alias("p"), F.when((rho > 0) & (rho < 1), -F.log(F.lit(2.0)) / F.log(rho)).alias("life")).toPandas()
    assert len(want) == 12 and want.p.notna().sum() >= 10
    np.testing.assert_allclose(want.p_value, want.p, rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(want.half_life, want.life, rtol=1e-9, atol=1e-12)
    plan = registry.queries()["a68_pair_regression"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("FlatMapGroupsInArrow")].lower()
    assert not any(f in above for f in ("round(", "exp(", "pow", "case when"))


def test_events_of_a_larger_table_are_dealt_over_more_tasks(spark, monkeypatch):
    j12 = registry.queries()["j12_nearest_event"]
    want = j12(spark, SF).toPandas()
    lines = len(pd.read_parquet(f"{SF}/lineitem.parquet"))
    monkeypatch.setattr(join_pair_queries, "EVENT_ROWS", 300)
    got = j12(spark, SF)
    assert f", {-(-lines // 300)})" in got._jdf.queryExecution().executedPlan().toString()  # hash partitions of the events
    keys = ["o_orderkey", "entity"]
    pd.testing.assert_frame_equal(*(x.sort_values(keys).reset_index(drop=True) for x in (got.toPandas(), want)))


def test_events_without_entity_or_time_meet_nothing_and_ties_go_back(spark):
    panel = spark.createDataFrame([(1, D[10], 10.0), (1, D[20], 11.0), (1, D[300], 22.0), (None, D[15], 5.0)], "e int, d date, p double")
    events = spark.createDataFrame([(1, 1, D[15]), (2, 1, D[16]), (3, 1, D[0]), (4, 1, D[399]), (5, 1, D[150]), (6, 2, D[15]), (7, None, D[15]), (8, 1, None), (9, 1, D[20])], "k int, e int, t date")
    for tasks in (None, 3):
        got = {r.k: (r.observed, r.ret_1) for r in asof.nearest(events, panel, "e", "t", "d", "p", [1], tasks).collect()}
        at = {k: None if v[0] is None else D.index(v[0]) for k, v in got.items()}
        assert at == {1: 10, 2: 20, 3: 10, 4: 300, 5: 20, 6: None, 7: None, 8: None, 9: 20}
        assert abs(got[1][1] - 0.1) < 1e-12 and abs(got[2][1] - 1.0) < 1e-12 and got[4][1] is None


def test_larger_groups_get_larger_blocks_and_the_same_pairs(spark, monkeypatch):
    g = np.random.default_rng(5)
    rows = [(s, "u" if s < 40 else "v", D[t], float(g.normal())) for s in range(48) for t in range(30) if s % 5 or t > 4]
    panel = spark.createDataFrame(rows, "entity int, sector string, date date, r double")
    whole = blocks.pair_stats(panel, *IN).toPandas().sort_values(["a", "b"]).reset_index(drop=True)
    assert len(whole) == 40 * 39 // 2 + 8 * 7 // 2
    monkeypatch.setattr(blocks, "BLOCK_SERIES", 4)
    most = lambda: {r.sector: r["n"] for r in blocks.deal(panel, *IN).series.groupBy("sector").agg(F.max("_blocks").alias("n")).collect()}
    assert most() == {"u": 10, "v": 2}
    monkeypatch.setattr(blocks, "BLOCK_PAIRS", 4)  # about 14 series a block, which kernels take in parts of 4
    assert most() == {"u": 3, "v": 1}
    pd.testing.assert_frame_equal(blocks.pair_stats(panel, *IN).toPandas().sort_values(["a", "b"]).reset_index(drop=True), whole, rtol=1e-9, atol=1e-12)
