"""Statistics of entity pairs in long form: one self join on (group, date), aggregated per pair at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import div, normal_tail, safe_corr
from tessera.operators.keys import meet
from tessera.scratch import cut


def paired(panel: DataFrame, entity: str, time: str, x: str, by: list[str]) -> DataFrame:
    """Rows (by, date, a, b, x, y) of all pairs a < b that have a value on the date.

    Work grows with the square of the entities of a group; block by group, and aggregate before anything else.
    """
    a = panel.where(F.col(x).isNotNull()).select(*by, time, F.col(entity).alias("a"), F.col(x).alias("x"))
    b = a.select(*by, time, F.col("a").alias("b"), F.col("x").alias("y"))
    return a.join(b, [*by, time]).where("a < b")


def pair_stats(pairs: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """N, correlation, covariance and regression of y on x of each pair with at least so many dates."""
    vx = F.var_samp("x")
    g = pairs.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("x"), F.col("y")).alias("corr"), F.covar_samp("x", "y").alias("cov"), F.when(vx > 0, div(F.covar_samp("x", "y"), vx)).alias("beta"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    return g.withColumn("alpha", F.col("_my") - F.col("beta") * F.col("_mx")).drop("_mx", "_my").where(F.col("n") >= least)


def rolling_corr(pairs: DataFrame, by: list[str], time: str, rows: int) -> DataFrame:
    """A43's input: rolling correlation of each pair over its last rows."""
    w = Window.partitionBy(*by, "a", "b").orderBy(time).rowsBetween(-(rows - 1), 0)
    vx, vy = F.var_samp("x").over(w), F.var_samp("y").over(w)
    return pairs.withColumn("corr", F.when((F.count(F.lit(1)).over(w) >= rows) & (vx > 0) & (vy > 0), div(F.covar_samp("x", "y").over(w), F.sqrt(vx * vy))))


def shrinkage(panel: DataFrame, entity: str, time: str, x: str, clip_sd: float = 2.5) -> DataFrame:
    """Covariance estimates of each ordered pair a <= b over common dates: s by population sums, that shrunk to a scaled identity by two intensities, and the sample covariance of winsorised series.

    intensity = clip((sum of pi off the diagonal) / d2 / T), with pi = mean(x_i^2 x_j^2) - S_ij^2 and d2 the squared distance
    to the target; intensity_oas = clip(((1 - 2/N) d2 + trace^2) / ((T + 1 - 2/N) d2)). Winsorised: each series held within
    clip_sd sample deviations of its mean. All of it is pairwise sums, so the matrix is never formed; the scalars are one
    aggregated row.
    """
    mean = panel.groupBy(entity).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_d"))
    held = F.when(F.col("_d") > 0, F.greatest(F.least(F.col(x), F.col("_m") + clip_sd * F.col("_d")), F.col("_m") - clip_sd * F.col("_d"))).otherwise(F.col(x))
    z = panel.join(mean, entity).select(entity, time, (F.col(x) - F.col("_m")).alias("z"), (held - F.col("_m")).alias("h"))
    a, b = (z.select(time, F.col(entity).alias(k), F.col("z").alias(v), F.col("h").alias(f"h{v}")) for k, v in (("a", "x"), ("b", "y")))
    p = a.join(b, time).where("a <= b")
    s = p.groupBy("a", "b").agg(F.avg(F.col("x") * F.col("y")).alias("s"), F.avg(F.col("x") ** 2 * F.col("y") ** 2).alias("q"), F.count(F.lit(1)).alias("n"), F.covar_samp("hx", "hy").alias("winsorised"), F.covar_samp("x", "y").alias("sample"))
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    pi = F.col("q") - F.col("s") ** 2
    t = s.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("s"))).alias("trace"), F.count_if(F.col("a") == F.col("b")).alias("names"), F.sum(twice * F.col("s") ** 2).alias("fro"), F.sum(F.when(F.col("a") != F.col("b"), 2 * pi)).alias("off"), F.max("n").alias("t"))
    mu = F.col("trace") / F.col("names")
    t = t.withColumn("mu", mu).withColumn("d2", F.col("fro") - F.col("names") * mu * mu)
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    oas = div((1 - 2 / F.col("names")) * F.col("d2") + F.col("trace") ** 2, (F.col("t") + 1 - 2 / F.col("names")) * F.col("d2"))
    t = t.select("mu", unit(F.coalesce(div(F.col("off"), F.col("d2")), F.lit(0.0)) / F.col("t")).alias("intensity"), unit(F.coalesce(oas, F.lit(1.0))).alias("intensity_oas"))
    target = F.when(F.col("a") == F.col("b"), F.col("mu")).otherwise(0.0)
    mixed = {f"shrunk{k}": F.col(f"intensity{k}") * target + (1 - F.col(f"intensity{k}")) * F.col("s") for k in ("", "_oas")}
    return s.join(F.broadcast(t)).withColumns(mixed).select("a", "b", "s", "sample", "intensity", "shrunk", "intensity_oas", "shrunk_oas", "winsorised")


def frobenius(matrix: DataFrame, base: str, others: list[str]) -> DataFrame:
    """Distance of each estimate from ``base`` over the whole symmetric matrix, given by its pairs a <= b, and relative to base's norm."""
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    g = matrix.agg(F.sqrt(F.sum(twice * F.col(base) ** 2)).alias("_norm"), *[F.sqrt(F.sum(twice * (F.col(c) - F.col(base)) ** 2)).alias(c) for c in others])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("estimate"), F.col(c).alias("gap"), div(F.col(c), F.col("_norm")).alias("relative")) for c in others]))
    return g.select(rows.alias("x")).select("x.*")


#: The mean correlation of a crisis and how far covariances are moved towards it under stress and outside it.
CRISIS_CORRELATION, BLEND_STRESS, BLEND_CALM = 0.40, 0.5, 0.1


def crisis_blend(matrix: DataFrame, stress: dict[str, bool]) -> DataFrame:
    """Covariances (a, b, s), pairs a <= b, blended with those whose correlations are all shifted by the gap of their mean from the crisis level and held inside -1 and 1; a column for each name, under stress or not."""
    v = matrix.where("a = b").select(F.col("a").alias("_k"), F.sqrt(F.greatest("s", F.lit(1e-18))).alias("_v"))
    m = matrix.join(v.select(F.col("_k").alias("a"), F.col("_v").alias("_va")), "a").join(v.select(F.col("_k").alias("b"), F.col("_v").alias("_vb")), "b")
    m = m.withColumn("_c", F.col("s") / (F.col("_va") * F.col("_vb")))
    mean = m.where("a <> b").agg(F.avg("_c").alias("_mean"))
    shifted = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.least(F.greatest(F.col("_c") + (CRISIS_CORRELATION - F.coalesce("_mean", F.lit(CRISIS_CORRELATION))), F.lit(-1.0)), F.lit(1.0)))
    crisis = F.col("_va") * F.col("_vb") * shifted
    share = lambda on: BLEND_STRESS if on else BLEND_CALM
    return m.join(F.broadcast(mean)).withColumns({n: share(on) * crisis + (1 - share(on)) * F.col("s") for n, on in stress.items()}).drop("_va", "_vb", "_c", "_mean")  # the mean is one row


def ewma_cov(pairs: DataFrame, by: list[str], time: str, lam: float = 0.94) -> DataFrame:
    """A47 in closed form: the weight of a row is (1 - lam) * lam ** (rows after it); the first row's product seeds it."""
    w = Window.partitionBy(*by, "a", "b").orderBy(F.col(time).desc())
    p = pairs.withColumn("_after", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "a", "b")))
    weight = F.when(F.col("_after") == F.col("_n") - 1, F.pow(F.lit(lam), F.col("_after"))).otherwise((1 - lam) * F.pow(F.lit(lam), F.col("_after")))
    return p.groupBy(*by, "a", "b").agg(F.sum(weight * F.col("x") * F.col("y")).alias("ewma"))


def tail_dependence(pairs: DataFrame, by: list[str], q: float = 0.05, least: int = 20) -> DataFrame:
    """Joint exceedance rate over q of both upper and both lower tails, thresholds by pair over its own dates."""
    keys = [*by, "a", "b"]
    cut = pairs.groupBy(*keys).agg(*[F.percentile(c, F.lit(p)).alias(f"{c}{s}") for c in ("x", "y") for p, s in ((q, "l"), (1 - q, "u"))], F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rate = lambda cond: F.avg(cond.cast("double")) / q
    return pairs.join(cut, keys).groupBy(*keys).agg(rate((F.col("x") > F.col("xu")) & (F.col("y") > F.col("yu"))).alias("upper"), rate((F.col("x") < F.col("xl")) & (F.col("y") < F.col("yl"))).alias("lower"))


def half_life(spread: DataFrame, keys: list[str], time: str, s: str) -> DataFrame:
    """A68, second pass: half-life -ln 2 / ln(slope) of the spread's first-order regression, null where the slope isn't inside (0, 1), and t, the unit-root statistic (1 - slope) / its standard error, large where the spread reverts."""
    lagged = spread.withColumn("_l", F.lag(s).over(Window.partitionBy(*keys).orderBy(time))).where("_l IS NOT NULL")
    g = lagged.groupBy(*keys).agg(F.when(F.var_samp("_l") > 0, div(F.covar_samp("_l", s), F.var_samp("_l"))).alias("rho"), F.var_samp("_l").alias("_vl"), F.var_samp(s).alias("_vs"), F.count(F.lit(1)).alias("n"))
    error = F.sqrt(div(F.col("_vs") - F.col("rho") ** 2 * F.col("_vl"), F.col("_vl") * (F.col("n") - 2)))
    g = g.withColumn("t", F.when((F.col("n") > 2) & (error > 0), (1 - F.col("rho")) / error)).drop("_vl", "_vs", "n")
    return g.withColumn("half_life", F.when((F.col("rho") > 0) & (F.col("rho") < 1), -F.log(F.lit(2.0)) / F.log("rho")))


def corr_p_value(corr: Column, n: Column) -> Column:
    """A69's input: two-sided p-value of a correlation over n dates by its t statistic and the normal tail; 0 where it is 1 in size."""
    t = F.abs(corr) * F.sqrt(div(n - 2, 1 - corr * corr))
    return F.when(F.abs(corr) >= 1, F.lit(0.0)).otherwise(2 * normal_tail(t))


#: Cells that p-values are counted in.
STEP_UP_CELLS = 1 << 16


def step_up_limits(tests: DataFrame, p: str, alpha: float = 0.1, by: list[str] | None = None) -> DataFrame:
    """(by, limit): the largest p-value that the Benjamini-Hochberg step-up over each group's rows lets pass, alpha * k / n with the largest k such that k values are at most that; 0 where none passes but values of 0.

    Rows are counted twice and never written. Rows without p are no tests.
    """
    by = by or []
    given = tests.where(F.col(p).isNotNull() & ~F.isnan(p)).select(*by, F.col(p).alias("_p"), F.floor(F.col(p) * STEP_UP_CELLS).alias("_cell"))
    cells = given.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    return limits_of_cells(cells, lambda some: meet(given, some, [*by, "_cell"]).groupBy(*by, "_cell", "_p").agg(F.count(F.lit(1)).alias("_c")), alpha, by)


def limits_of_cells(cells: DataFrame, values: Callable[[DataFrame], DataFrame], alpha: float, by: list[str]) -> DataFrame:
    """(by, limit) of ``step_up_limits`` from (by, _cell, _c), how many p-values lie in each cell of STEP_UP_CELLS, and from ``values``, which gives (by, _cell, _p, _c), how often each value of some cells (by, _cell) occurs.

    The counts bound the limit: a cell passes whole if its upper end does, and holds no passing value if its lower end
    doesn't. Only the values of the cells above the last that passes whole, and not ruled out, are put in order. Values
    above alpha never pass and may be counted in any cell above it.
    """
    group = Window.partitionBy(*by or [F.lit(0)])  # a row for each cell
    cells = cells.withColumns({"_upto": F.sum("_c").over(group.orderBy("_cell")), "_n": F.sum("_c").over(group)})
    limit = lambda k: F.lit(alpha) * k / F.col("_n")
    whole = F.max(F.when((F.col("_cell") + 1) / F.lit(float(STEP_UP_CELLS)) <= limit(F.col("_upto")), F.col("_upto"))).over(group)
    told = cut(cells.withColumn("_whole", F.coalesce(whole, F.lit(0))), "cells")
    open_cells = told.where((F.col("_upto") > F.col("_whole")) & (F.col("_cell") / F.lit(float(STEP_UP_CELLS)) <= limit(F.col("_upto"))))
    found = meet(values(open_cells.select(*by, "_cell")), open_cells.select(*by, "_cell", (F.col("_upto") - F.col("_c")).alias("_before"), "_n"), [*by, "_cell"])
    k = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_cell").orderBy("_p"))  # the distinct values of one cell
    best = found.withColumn("_k", k).where(F.col("_p") <= limit(F.col("_k"))).select(*by, "_k", "_n")
    return told.select(*by, F.col("_whole").alias("_k"), "_n").unionByName(best).groupBy(*by).agg(F.max("_k").alias("_k"), F.max("_n").alias("_n")).select(*by, limit(F.col("_k")).alias("limit"))


def step_up(df: DataFrame, p: str, alpha: float = 0.1, by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg step-up over all rows, or over those of each ``by`` group. Equal p-values share their fate, so ``ties`` (which once ordered them) decide nothing."""
    by = by or []
    limits = cut(step_up_limits(df, p, alpha, by).withColumnRenamed("limit", "_limit"), "limits")
    told = meet(df, limits, by, "left") if by else df.join(F.broadcast(limits), how="left")
    return told.withColumn("survives", F.coalesce(F.col(p) <= F.col("_limit"), F.lit(False))).drop("_limit")
