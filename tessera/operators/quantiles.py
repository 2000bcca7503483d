"""Exact quantiles of large groups by refining histograms.

Spark's own exact percentile keeps every distinct value of a group in one task. Here a group's distinct values stay
spread out: split values cut them into buckets, the buckets' weights tell which ones hold the wanted ranks, and only
those are cut again, until each is small enough to be put in order by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.keys import meet
from tessera.scratch import cut, discard

#: Distinct values that one task puts in order.
BUCKET_ROWS = 100_000
#: Buckets of one refinement.
SPLITS = 256


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(by, one column for each name in wanted): quantiles of the values that aren't null in each group, interpolated as by ``percentile``; groups without values have no row.

    No task holds more than about BUCKET_ROWS distinct values of a group, or of one bucket of it.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    now = cut(rows.withColumn("_cell", F.lit("")), "values")  # a cell is the path of buckets that led to it
    size = now.groupBy(*by).agg(F.sum("_c").alias("_n"))
    ranks = []  # (name, place of the rank below and the weight of the one above)
    for i, (_, p) in enumerate(wanted.items()):
        at = (F.col("_n") - 1) * F.lit(p)
        ranks += [F.struct(F.lit(i).alias("_i"), F.lit(k).alias("_k"), (f(at)).cast("long").alias("_rank"), (at - F.floor(at)).alias("_part")) for k, f in enumerate((F.floor, F.ceil))]
    goals = cut(size.select(*by, F.explode(F.array(*ranks)).alias("_g")).select(*by, "_g.*", F.lit("").alias("_cell"), F.lit(0).cast("long").alias("_before")), "ranks")
    keys = [*by, "_cell"]
    while (now.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > BUCKET_ROWS:
        ways = [k / SPLITS for k in range(1, SPLITS)]
        splits = now.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), F.percentile_approx("_v", ways, 10 * SPLITS).alias("_splits"))
        bucket = F.when(F.col("_m") > BUCKET_ROWS, F.size(F.filter("_splits", lambda s: s < F.col("_v")))).otherwise(F.lit(0))
        dealt = cut(meet(now, splits, keys).withColumn("_b", bucket).drop("_m", "_splits"), "values")
        weight = dealt.groupBy(*keys, "_b").agg(F.sum("_c").alias("_w"))
        ladder = weight.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_b", "_w"))).alias("_ladder"))  # at most SPLITS entries
        steps = F.expr("aggregate(_ladder, named_struct('b', -1, 'before', _before, 'w', 0L), (s, x) -> CASE WHEN s.before + s.w > _rank AND s.b >= 0 THEN s ELSE named_struct('b', x._b, 'before', s.before + s.w, 'w', x._w) END)")
        told = meet(goals, ladder, keys).withColumn("_s", steps)
        cell = F.concat("_cell", F.lit("/"), F.col("_s.b").cast("string"))
        after = cut(told.select(*by, "_i", "_k", "_rank", "_part", cell.alias("_cell"), F.col("_s.before").alias("_before")), "ranks")
        kept = dealt.withColumn("_cell", F.concat("_cell", F.lit("/"), F.col("_b").cast("string"))).drop("_b")
        live = after.select(*keys).distinct().withColumn("_live", F.lit(True))
        then = cut(meet(kept, live, keys).drop("_live"), "values")
        discard(now, goals, dealt)
        now, goals = then, after
    # What is left of a cell is put in order in one array, whose running weights find each rank.
    ordered = now.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_v", "_c"))).alias("_values"))
    found = F.expr("aggregate(_values, named_struct('v', CAST(NULL AS DOUBLE), 'upto', _before), (s, x) -> CASE WHEN s.upto > _rank THEN s ELSE named_struct('v', x._v, 'upto', s.upto + x._c) END).v")
    got = meet(goals, ordered, keys).select(*by, "_i", "_k", "_part", found.alias("_v"))
    low, high = (lambda i: F.max(F.when((F.col("_i") == i) & (F.col("_k") == 0), F.col("_v")))), (lambda i: F.max(F.when((F.col("_i") == i) & (F.col("_k") == 1), F.col("_v"))))
    part = lambda i: F.max(F.when(F.col("_i") == i, F.col("_part")))
    mixed = {n: F.when(part(i) == 0, low(i)).otherwise((1 - part(i)) * low(i) + part(i) * high(i)) for i, n in enumerate(wanted)}
    return got.groupBy(*by).agg(*[c.alias(n) for n, c in mixed.items()])


def medians(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    return quantiles(df, by, value, {name: 0.5})
