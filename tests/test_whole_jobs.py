"""Queries over whole tables against plain loops over all rows."""

import collections
import datetime as dt
import os

import pandas as pd

from tessera import registry
from tessera.operators import backtest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def test_lots_of_the_whole_ledger_equal_a_queue(spark):
    got = registry.queries()["a85_lot_matching"](spark, SF).toPandas()
    li = rows("lineitem")
    li["day"], sells = li.l_shipdate.astype("datetime64[ns]").dt.normalize(), li.l_returnflag == "R"
    text = ["-".join(map(str, x)) for x in zip(li.l_orderkey, li.l_linenumber, li.l_suppkey, li.l_extendedprice, strict=True)]
    li = li.assign(seq=text, left=li.l_quantity.astype(float), sell=sells).sort_values(["day", "seq"])
    want = collections.Counter()
    for part, g in li.groupby("l_partkey"):
        buys = collections.deque([r.seq, r.left] for r in g[~g.sell].itertuples())
        for r in g[g.sell].itertuples():
            need = r.left
            while need > 0 and buys:
                n = min(need, buys[0][1])
                want[part, buys[0][0], r.seq, round(n, 6)] += 1
                need, buys[0][1] = need - n, buys[0][1] - n
                if buys[0][1] <= 0:
                    buys.popleft()
    assert want == collections.Counter((r.entity, r.buy, r.sell, round(float(r.qty), 6)) for r in got.itertuples())
    assert {r.entity for r in got.itertuples()} == set(li[~li.sell].l_partkey) & set(li[li.sell].l_partkey)


def test_every_order_meets_every_supplier_of_its(spark):
    got = registry.queries()["j12_nearest_event"](spark, SF).toPandas()
    li, o = rows("lineitem"), rows("orders")
    want = o[["o_orderkey", "o_orderdate"]].merge(li[["l_orderkey", "l_suppkey"]].drop_duplicates(), how="left", left_on="o_orderkey", right_on="l_orderkey").drop_duplicates()
    months = {e: sorted(set(g.astype("datetime64[ns]").dt.to_period("M").dt.to_timestamp())) for e, g in li.groupby("l_suppkey").l_shipdate}
    near = lambda r: min(months[r.l_suppkey], key=lambda m: (abs((m - r.day).days), m)) if r.l_suppkey == r.l_suppkey else None
    want["day"] = want.o_orderdate.astype("datetime64[ns]").dt.normalize()
    show = lambda k, e, m: (k, None if e != e else int(e), None if m is None or m != m else str(m)[:10])
    assert sorted(map(str, (show(r.o_orderkey, r.l_suppkey, near(r)) for r in want.itertuples()))) == sorted(map(str, (show(r.o_orderkey, r.entity, r.observed) for r in got.itertuples())))
    assert set(got.entity.dropna()) == set(li.l_suppkey) and set(got.o_orderkey) == set(o.o_orderkey)


def test_gaps_are_those_of_the_whole_series(spark):
    got = {r.entity: r.gap for r in registry.queries()["p09_unadjusted"](spark, SF).collect()}
    gap = rows("lineitem").groupby("l_suppkey").l_discount.mean()
    assert set(got) == set(gap[gap < 0.05037].index) and all(abs(got[e] - gap[e]) < 6e-5 for e in got)


def test_pivot_has_a_column_for_each_region(spark):
    got = registry.queries()["a06_pivot_wide"](spark, SF)
    assert set(got.columns) == {"date", *map(str, rows("region").r_regionkey)}


def test_real_bars_stay_and_short_series_are_padded(spark):
    li = rows("lineitem")
    bars = {(e, str(m)) for e, m in zip(li.l_suppkey, li.l_shipdate.astype("datetime64[ns]").dt.to_period("M"), strict=True)}
    out = registry.queries()["w46_padded_context"](spark, SF).toPandas()
    month = lambda x: {(r.entity, str(r.date)[:7]) for r in x.itertuples()}
    assert month(out[~out.padded]) == bars and not month(out[out.padded]) & bars
    day = lambda k: dt.date(2024, k, 1)
    panel = spark.createDataFrame([(1, "g", day(k), 10.0 * k) for k in range(1, 7)] + [(2, "g", day(k), 80.0) for k in (5, 6)], "entity int, sector string, date date, price double")
    proxy = spark.createDataFrame([("g", day(k), 2.0 * k) for k in range(1, 7)], "sector string, date date, price double")
    pads = sorted((r.entity, r.date, r.price) for r in backtest.pad_context(panel, proxy, "entity", "sector", "date", "price", 4).where("padded").collect())
    assert pads == [(2, day(3), 48.0), (2, day(4), 64.0)]


def test_fill_takes_the_last_known_value_of_every_month(spark):
    got = {(r.entity, r.date): r.m for r in registry.queries()["j13_exogenous_fill"](spark, SF).collect()}
    r = rows("lineitem")
    r["date"] = r.l_shipdate.astype("datetime64[ns]").dt.to_period("M").dt.to_timestamp()
    b = r.groupby(["l_suppkey", "date"])[["l_extendedprice", "l_quantity"]].sum().reset_index().sort_values(["l_suppkey", "date"])
    b["price"] = b.l_extendedprice.astype(float) / b.l_quantity.astype(float) / 1.07
    b["m"] = b.date.map(b.assign(r=b.price / b.groupby("l_suppkey").price.shift() - 1).groupby("date").r.mean())
    b["m"] = b.groupby("l_suppkey").m.ffill()
    assert len(got) == len(b)
    for x in b.itertuples():
        m = got[x.l_suppkey, x.date.date()]
        assert m is None if x.m != x.m else abs(m - x.m) < 1e-5


def test_more_ties_than_a_cap_stay_in_the_top(spark, tmp_path):
    n = 2100
    keys = list(range(n))
    pd.DataFrame({"c_custkey": keys, "c_mktsegment": "BUILDING"}).to_parquet(tmp_path / "customer.parquet")
    pd.DataFrame({"o_orderkey": keys, "o_custkey": keys, "o_totalprice": 1000.0, "o_orderstatus": "O", "o_orderdate": pd.Timestamp("1998-01-05")}).astype({"o_orderdate": "datetime64[us]"}).to_parquet(tmp_path / "orders.parquet")
    got = registry.queries()["p23_explore_segment"](spark, str(tmp_path)).collect()
    assert len(got) == n and {r["rank"] for r in got} == {1}
