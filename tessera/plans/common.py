"""Panels that the registered queries are built on, as DataFrames and as SQL with the same names.

bars: monthly price, quantity and price range of each supplier; rets: their returns; fund: dated ratios of each
customer from orders; sect: group of each supplier; regime: a label for each month by market volatility.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import registry
from tessera.functions.columns import div, over
from tessera.operators import returns
from tessera.scratch import cut

#: Prices are net of 7 % tax, and the ratios below are over primes, so that no value lies halfway between two rounded ones.
TAX = 1.07

CTE = {
    "bars": """SELECT l_suppkey AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) / 1.07::DOUBLE AS price,
 sum(l_quantity) AS qty, max(l_extendedprice / l_quantity) / 1.07::DOUBLE AS high, min(l_extendedprice / l_quantity) / 1.07::DOUBLE AS low FROM lineitem GROUP BY 1, 2""",
    "rets": """SELECT *, price / lag(price) OVER w - 1 AS r, ln(price / lag(price) OVER w) AS lr FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)""",
    "sect": "SELECT s_suppkey AS entity, s_nationkey AS sector, n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "market": "SELECT date, avg(r) AS m FROM rets WHERE r IS NOT NULL GROUP BY date",
    "regime": """SELECT date, m, CASE WHEN abs(m) > 0.17 THEN 'high' WHEN abs(m) < 0.13 THEN 'low' ELSE 'normal' END AS regime FROM market""",
    "fund": """SELECT o_custkey AS entity, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS as_of, avg(o_totalprice) / 1499977 AS roe,
 CASE WHEN count(*) > 1 THEN max(o_totalprice) / 2000003 END AS roic, 2 * min(o_totalprice) / max(o_totalprice) AS de, 20 - avg(o_totalprice) / 19997 AS ev,
 CAST(0.7 * count(*) AS DOUBLE) AS pb, sum(o_totalprice) / 999983 AS mca, min(o_totalprice) / max(o_totalprice) AS stab, sum(o_totalprice) / 99991 AS ic, sum(o_totalprice) AS amount FROM orders GROUP BY 1, 2""",
    "latest": "SELECT * FROM fund QUALIFY row_number() OVER (PARTITION BY entity ORDER BY as_of DESC) = 1",
}
_NEEDS = {"rets": ["bars"], "market": ["rets"], "regime": ["market"], "latest": ["fund"]}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in [*_closure(_NEEDS.get(n, [])), n]:
            if x not in out:
                out.append(x)
    return out


def sql(body: str, *names: str) -> str:
    """body behind the named tables of CTE; a body that begins with a comma adds tables of its own."""
    parts = ", ".join(f"{n} AS ({CTE[n]})" for n in _closure(list(names)))
    again = "RECURSIVE " if " rec AS (" in body else ""
    return f"WITH {again}{parts} {body}" if parts else body


def query(body: str | None = None, *names: str) -> Callable:
    return registry.query(sql(body, *names) if body else None)


#: Panels that the query being planned has written, by name and by folder of the tables.
_written: ContextVar[dict[str, dict[str, DataFrame]] | None] = ContextVar("written", default=None)


@contextmanager
def panels_once(*names: str) -> Iterator[None]:
    """Inside it the named panels (bars, fund) are written once and read by all steps, where each would make them anew from lineitem or orders; for queries that take many steps from them. What is inside another one goes by the outer one."""
    if _written.get() is not None:
        yield
        return
    token = _written.set({n: {} for n in names})
    try:
        yield
    finally:
        _written.reset(token)


def _once(name: str, d: str, make: Callable[[], DataFrame]) -> DataFrame:
    held = _written.get()
    if held is None or name not in held:
        return make()
    if d not in held[name]:
        held[name][d] = cut(make(), name)
    return held[name][d]


def bars(spark: SparkSession, d: str) -> DataFrame:
    return _once("bars", d, lambda: _bars(spark, d))


def _bars(spark: SparkSession, d: str) -> DataFrame:
    li = registry.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").alias("t"), "l_extendedprice", "l_quantity")
    b = returns.resample(li, "month", "entity", "t", "l_extendedprice", "l_quantity")
    return b.withColumns({c: F.col(c) / TAX for c in ("price", "high", "low")})


def rets(spark: SparkSession, d: str) -> DataFrame:
    return returns.with_returns(bars(spark, d), "entity", "date", "price")


def sect(spark: SparkSession, d: str) -> DataFrame:
    nation = registry.table(spark, d, "nation").select(F.col("n_nationkey").alias("sector"), F.col("n_regionkey").alias("region"))
    return registry.table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("sector")).join(nation, "sector")


def market(spark: SparkSession, d: str) -> DataFrame:
    return rets(spark, d).where("r IS NOT NULL").groupBy("date").agg(F.avg("r").alias("m"))


def regime(spark: SparkSession, d: str) -> DataFrame:
    return market(spark, d).withColumn("regime", F.expr("CASE WHEN abs(m) > 0.17 THEN 'high' WHEN abs(m) < 0.13 THEN 'low' ELSE 'normal' END"))


def named_regime(spark: SparkSession, d: str) -> DataFrame:
    """The regimes under the names that policies and plans know."""
    return regime(spark, d).withColumn("regime", F.expr("CASE regime WHEN 'high' THEN 'high_vol_stress' WHEN 'low' THEN 'low_vol' ELSE regime END"))


def fund(spark: SparkSession, d: str) -> DataFrame:
    return _once("fund", d, lambda: _fund(spark, d))


def _fund(spark: SparkSession, d: str) -> DataFrame:
    o = registry.table(spark, d, "orders")
    p = F.col("o_totalprice")
    g = o.groupBy(F.col("o_custkey").alias("entity"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("as_of"))
    return g.agg(
        (F.avg(p) / 1499977).alias("roe"), F.when(F.count(p) > 1, F.max(p) / 2000003).alias("roic"), div(2 * F.min(p), F.max(p)).alias("de"), (20 - F.avg(p) / 19997).alias("ev"),
        (7 * F.count(p) / F.lit(10.0)).alias("pb"), (F.sum(p) / 999983).alias("mca"), div(F.min(p), F.max(p)).alias("stab"), (F.sum(p) / 99991).alias("ic"), F.sum(p).alias("amount"),
    )


def latest(spark: SparkSession, d: str) -> DataFrame:
    return returns.latest(fund(spark, d), "entity", "as_of")


def r6(*names: str) -> list:
    """The named columns rounded to 6 decimals, as the SQL of the oracle rounds them."""
    return [F.round(F.col(n), 6).alias(n) for n in names]


__all__ = ["bars", "fund", "latest", "market", "named_regime", "over", "panels_once", "query", "r6", "rets", "sect", "sql"]
