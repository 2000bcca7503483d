"""Small column expressions that several operators share. Null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DAYS_PER_YEAR = 252


def over(entity: str | list[str], time: str) -> WindowSpec:
    """Rows of an entity in time order. A panel's entity has a bounded history, so its window fits a task."""
    return Window.partitionBy(*([entity] if isinstance(entity, str) else entity)).orderBy(time)


def trailing(entity: str | list[str], time: str, rows: int) -> WindowSpec:
    return over(entity, time).rowsBetween(-(rows - 1), 0)


def so_far(entity: str | list[str], time: str) -> WindowSpec:
    return over(entity, time).rowsBetween(Window.unboundedPreceding, 0)


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, b)


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles as floating point has it: infinite or NaN, not null, where b is 0."""
    at_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(a.isNotNull() & (b == 0), at_zero).otherwise(F.try_divide(a, b))


def clip(x: Column, low: float, high: float) -> Column:
    """x held between low and high; null stays null (least and greatest would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def clean(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(x: Column) -> Column:
    """tolerant cast to double."""
    return x.try_cast("double")


def date_key(x: Column) -> Column:
    """tolerant cast to a date."""
    return x.try_cast("date")


def token(x: Column, null_words: tuple[str, ...] = ("", "NAN", "NONE", "NULL", "N/A", "-")) -> Column:
    """trimmed upper case; null words become null."""
    t = F.upper(F.trim(x))
    return F.when(~t.isin(*null_words), t)


def slug(x: Column, length: int = 24) -> Column:
    """a name as upper-case letters, digits and underscores."""
    return F.upper(F.substring(F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""), 1, length))


def bins(x: Column, edges: list[float], labels: list[str]) -> Column:
    """the label of the first edge at or above x; the last label beyond all edges."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for e, name in zip(edges, labels, strict=False):
        out = out.when(x <= e, name)
    return out.otherwise(labels[-1])


def third_friday(first_of_month: Column) -> Column:
    """the third Friday of the month that begins at the given date."""
    return F.date_add(F.next_day(F.date_sub(first_of_month, 1), "Fri"), 14)


def pct_rank(x: Column, part: WindowSpec) -> Column:
    """Average-tie percentile rank among the non-null values of the partition; null stays null.

    part: partitionBy only. Ranks put nulls last so that they don't shift the others.
    """
    spec = part.orderBy(x.asc_nulls_last())
    n = F.count(x).over(part)
    return F.when(x.isNotNull(), div(F.rank().over(spec) + (F.count(F.lit(1)).over(spec.rangeBetween(0, 0)) - 1) / 2, n))


def zscore(x: Column, part: WindowSpec) -> Column:
    """Z-score in the partition by the sample deviation; 0 where that is 0 or missing or x is null."""
    sd = F.stddev_samp(x).over(part)
    return F.when((sd > 0) & x.isNotNull(), (x - F.avg(x).over(part)) / sd).otherwise(F.lit(0.0))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns but maps, which have none: decides between rows that tie."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])


def normal_tail(x: Column) -> Column:
    """P(Z > x) of the standard normal, to 8e-8 (Abramowitz and Stegun, 26.2.17; fixed coefficients)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = 0.3989422804014327 * F.exp(-x * x / 2) * poly
    return F.when(x >= 0, upper).otherwise(1 - upper)


#: MacKinnon's (1994) response surfaces of the unit-root statistic with a constant, by the number of series: coefficients up to the border and beyond it, the border, and where p is 0 and 1.
UNIT_ROOT = {
    1: ((2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), -1.61, -18.83, 2.74),
    2: ((2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377), -2.62, -18.86, 0.92),
    3: ((3.4699, 1.4856, 0.03164), (2.5893, 0.45168, -0.36529, -0.050074), -3.13, -23.48, 0.55),
}


def unit_root_p(t: Column, series: int = 2) -> Column:
    """P-value of a unit-root statistic, small (negative) where the series reverts; ``series``: 1 for a series of its own, 2 for the residual of one on another."""
    near, far, border, low, high = UNIT_ROOT[series]
    z = lambda c: sum((F.lit(k) * F.pow(t, F.lit(float(i))) for i, k in enumerate(c)), F.lit(0.0))
    p = normal_tail(-F.when(t <= border, z(near)).otherwise(z(far)))
    return F.when(t <= low, 0.0).when(t >= high, 1.0).when(t.isNotNull(), p)


def safe_corr(x: Column, y: Column) -> Column:
    """Correlation as an aggregate over rows where both are given; null where either is constant."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.when((F.var_samp(x) > 0) & (F.var_samp(y) > 0), div(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)))
