"""Reading, merging and writing panel tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.columns import clean, row_hash

#: Row count up to which an entity list is sent to all executors instead of being joined by shuffle.
FEW_ENTITIES = 10_000


def scan(spark: SparkSession, path: str, columns: list[str], entity: str | None = None, wanted: list | None = None) -> DataFrame:
    """The named columns of a Parquet table, its rows of the wanted entities; both reach the file scan."""
    df = spark.read.parquet(path).select(*columns)
    if wanted is None:
        return df
    if len(wanted) <= FEW_ENTITIES:
        return df.where(F.col(entity).isin(*wanted))
    return df.join(spark.createDataFrame([(x,) for x in wanted], [entity]), entity, "left_semi")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def prefer(spark: SparkSession, first: str, second: str) -> DataFrame:
    """The first table where it exists, else the second."""
    return spark.read.parquet(first if exists(spark, first) else second)


def adjusted(df: DataFrame, price: str, adjusted_price: str) -> DataFrame:
    """The adjusted price under the price's name."""
    return df.withColumn(price, F.col(adjusted_price)).drop(adjusted_price)


def csv_prices(spark: SparkSession, path: str) -> DataFrame:
    """Date, entity, open, close and optional columns from CSV; missing ones get defaults, missing required ones an error."""
    df = spark.read.csv(path, header=True)
    if lacking := {"date", "entity", "close"} - set(df.columns):
        raise ValueError(f"columns are missing: {sorted(lacking)}")
    num = {c: F.col(c).try_cast("double") for c in ("open", "high", "low", "close", "volume") if c in df.columns}
    df = df.withColumns(num | {"date": F.col("date").try_cast("date")})
    opened = F.col("open") if "open" in df.columns else F.col("close")
    df = df.withColumn("open", opened)
    defaults = {"high": F.greatest("open", "close"), "low": F.least("open", "close"), "volume": F.lit(0.0), "source": F.lit("csv")}
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in defaults.items()})


def append_last_wins(base: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Both tables, one row per key: that of the highest sequence number, of equal ones the new table's, then that of the largest hash."""
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc(), F.col("_new").desc(), row_hash(base).desc())
    return base.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def resolve_conflicts(df: DataFrame, keys: list[str], numbers: list[str], label: str) -> DataFrame:
    """One row per key with mean numbers, the smallest label and whether the first number differed."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in numbers], F.min(label).alias(label), (F.count_distinct(numbers[0]) > 1).alias("conflict"))


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace base rows of the same key."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def rescaled(base: DataFrame, new: DataFrame, keys: list[str], entity: str, value: str, tolerance: float = 0.01) -> DataFrame:
    """Entities whose re-read values moved by more than the tolerance, with the largest relative shift."""
    both = base.select(*keys, F.col(value).alias("_old")).join(new.select(*keys, F.col(value).alias("_new")), keys)
    return both.groupBy(entity).agg(F.max(F.abs(F.try_divide("_new", "_old") - 1)).alias("shift")).where(F.col("shift") > tolerance)


def merge_staged(base: DataFrame, stage: DataFrame, path: str) -> None:
    """Base and stage as one table, written with zstd to a new path."""
    base.unionByName(stage).write.option("compression", "zstd").parquet(path)


def uncovered(members: DataFrame, facts: DataFrame, entity: str) -> DataFrame:
    """Members without rows in the fact table."""
    return members.join(facts.select(entity), entity, "left_anti")


def replace_groups(df: DataFrame, path: str, by: list[str]) -> None:
    """The groups that df holds replace theirs in the partitioned table; others stay."""
    df.write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def records(df: DataFrame) -> DataFrame:
    """One JSON text per row, NaN and infinities as null, dates in ISO form."""
    cols = [clean(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("record"))


def recent(df: DataFrame, time: str, days: int, rows: int | None = None) -> DataFrame:
    """Rows of the last so many days up to the newest date; with ``rows``, the newest so many of them (the export's own cap)."""
    last = df.agg(F.max(time).alias("_last"))
    out = df.join(F.broadcast(last), F.col(time) >= F.date_sub("_last", days)).drop("_last")
    return out if rows is None else out.orderBy(F.col(time).desc(), *[F.col(f"`{c}`") for c in df.columns]).limit(rows)


def contract(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> DataFrame:
    """For each table of the contract its missing columns, its rows, the rows with a null in a required column, and ok: nothing is missing, rows are there and all are complete."""
    out = []
    for name, columns in required.items():
        df = tables.get(name)
        if df is None:
            raise ValueError(f"the contract names a table that isn't given: {name}")
        lack = [c for c in columns if c not in df.columns]
        gap = F.lit(False)
        for c in columns:
            if c not in lack:
                gap = gap | F.col(c).isNull()
        counted = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(gap).alias("incomplete"))
        out.append(counted.select(F.lit(name).alias("name"), F.lit(",".join(lack)).alias("missing"), "rows", "incomplete", (F.lit(not lack) & (F.col("rows") > 0) & (F.col("incomplete") == 0)).alias("ok")))
    return reduce(DataFrame.unionByName, out)


def fact_rows(docs: DataFrame, entity: str, text: str) -> DataFrame:
    """(entity, taxonomy, tag, unit, end, val, frame, filed) for each entry of JSON documents {facts: {taxonomy: {tag: {units: {unit: [entry]}}}}}.

    Whatever taxonomies, tags and units a document has are kept, and so are entries that lack fields or hold what can't
    be cast (null there). Texts that aren't JSON, or have no facts, give no rows.
    """
    spark = docs.sparkSession
    each = docs.select(F.col(entity).alias("entity"), F.try_parse_json(text).alias("_v"))
    each = each.select("entity", F.try_variant_get("_v", "$.facts", "variant").alias("_v"))
    for name in ("taxonomy", "tag"):
        each = _exploded(spark, each, name)
    each = _exploded(spark, each.withColumn("_v", F.try_variant_get("_v", "$.units", "variant")), "unit")
    each = _exploded(spark, each, None)
    get = lambda name, kind: F.try_variant_get("_v", f"$.{name}", kind).alias(name)
    return each.select("entity", "taxonomy", "tag", "unit", get("end", "date"), get("val", "double"), get("frame", "string"), get("filed", "date"))


def _exploded(spark: SparkSession, df: DataFrame, name: str | None) -> DataFrame:
    """A row for each field of the object, or entry of the array, in _v; the field's key under ``name``."""
    kept = [c for c in df.columns if c != "_v"]
    out = df.withColumnRenamed("_v", "_from").lateralJoin(spark.tvf.variant_explode(F.col("_from").outer()))
    return out.select(*kept, *([F.col("key").alias(name)] if name else []), F.col("value").alias("_v"))


def single_quarters(facts: DataFrame) -> DataFrame:
    """Rows of fact_rows() whose frame is one quarter, the latest filing per entity, taxonomy, tag, unit and period end."""
    quarter = facts.where(F.col("frame").rlike(r"^CY[0-9]{4}Q[1-4]I?$"))
    w = Window.partitionBy("entity", "taxonomy", "tag", "unit", "end").orderBy(F.col("filed").desc(), F.col("val").desc())
    return quarter.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def patch(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Listed columns take the change's value where it has one; keys that base lacks are added."""
    c = changes.select(F.col(key), *[F.col(x).alias(f"_{x}") for x in columns])
    both = base.join(c, key, "full_outer")
    return both.select(*[F.coalesce(f"_{x}", x).alias(x) if x in columns else F.col(x) for x in base.columns])


def memberships(df: DataFrame, entity: str, flags: list[str]) -> DataFrame:
    """Boolean flag columns as (index, entity) rows."""
    return df.unpivot(entity, flags, "index", "member").where("member").select("index", entity)
