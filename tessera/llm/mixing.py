"""Mixing sources to target weights: repetition rates per source, whole copies plus one Bernoulli copy per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.scratch import cut, discard, ordered_prefix

#: Sources up to this many rows are broadcast; beyond it the join is shuffled and its hot sources split.
BROADCAST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) for each source, null a source of its own.

    Sources by code point, null last, weigh 1, 2, 3, repeating. They share the total size by weight; a target stops at
    cap times its source's size and the excess goes to the others by weight until none is above. That water level is
    the largest of (total - caps of the k sources first filled) / (weights of the others) over all k, so one ordered
    prefix sum finds it without a loop.
    """
    each = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    ranked = ordered_prefix(each.select("*", F.col("source").isNull().alias("_null")), ["_null", "source"], [], "sources")
    weighed = cut(ranked.select("source", "source_size", (F.col("pos") % 3 + 1).cast("double").alias("w"), (F.col("source_size") * F.lit(cap)).alias("cap")).withColumn("ratio", F.col("cap") / F.col("w")), "weighed")
    filled = ordered_prefix(weighed, ["ratio", "source"], ["w", "cap"], "filled")
    total, weights = weighed.agg(F.sum("source_size").cast("double"), F.sum("w")).first()
    if not weights:
        return weighed.select("source", "source_size", F.col("cap").alias("target"))
    level = filled.agg(F.max((F.lit(total) - F.col("cap_before")) / (F.lit(weights) - F.col("w_before")))).first()[0]
    return weighed.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(level)).alias("target"))


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) from 52 bits of MD5, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


#: A row counts as large where its size times this is above its source's: so a source has fewer large rows than this.
LARGE = 50
#: Steps of the scale on which the limit of the other rows' draws is set.
STEPS = 4096


def _limits(rows: DataFrame) -> DataFrame:
    """(source, extra, limit) from rows (source, size, u, part, source_size): which draws take the copy for the fraction ``part``.

    Every draw u is uniform, so each row's chance is the source's fraction; what is set here lets the errors of a
    source's draws cancel. Its large rows are decided from the largest down, each at u < part + owed / size, where owed
    is what the draws before took less than their share; ``extra`` lists the draws that take. The other rows have one
    limit, at that step of the scale where the words they take come nearest to their share and what is still owed.
    """
    large = F.col("size") * LARGE > F.col("source_size")
    some = rows.where(large).groupBy("source", "part").agg(F.sort_array(F.collect_list(F.struct("size", "u")), asc=False).alias("all"))
    none = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<double>").alias("extra"))

    def decide(state: Column, row: Column) -> Column:
        takes = row["u"] < F.col("part") + state["owed"] / row["size"]
        owed = state["owed"] + F.col("part") * row["size"] - F.when(takes, row["size"].cast("double")).otherwise(F.lit(0.0))
        return F.struct(owed.alias("owed"), F.when(takes, F.concat(state["extra"], F.array(row["u"]))).otherwise(state["extra"]).alias("extra"))

    decided = some.select(F.col("source").alias("_large"), F.aggregate("all", none, decide).alias("d")).select("_large", "d.owed", "d.extra")
    steps = rows.where(~large).groupBy("source", "part", F.floor(F.col("u") * STEPS).alias("step")).agg(F.sum("size").alias("words"))
    walked = steps.select("*", F.expr("sum(words) OVER (PARTITION BY source ORDER BY step)").alias("upto"), F.expr("sum(words) OVER (PARTITION BY source)").alias("total"))  # at most STEPS rows of a source
    met = walked.join(decided, F.col("source").eqNullSafe(F.col("_large")), "left").withColumn("goal", F.col("part") * F.col("total") + F.coalesce("owed", F.lit(0.0)))
    best = met.groupBy("source").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("goal")).alias("off"), F.col("step"))).alias("b"), F.min(F.abs("goal")).alias("off0"))
    limit = best.select(F.col("source").alias("_small"), F.when(F.col("off0") <= F.col("b.off"), F.lit(0.0)).otherwise((F.col("b.step") + 1) / F.lit(float(STEPS))).alias("limit"))
    return decided.join(limit, F.col("_large").eqNullSafe(F.col("_small")), "full").select(F.when(F.col("limit").isNull(), F.col("_large")).otherwise(F.col("_small")).alias("source"), F.coalesce("extra", F.array().cast("array<double>")).alias("extra"), F.coalesce("limit", F.lit(0.0)).alias("limit"))


def mix(rows: DataFrame, source: str, size: str, key: Column, seed: str = "mix", cap: float = 3.0) -> DataFrame:
    """rows with source_size, target, rate and ``copies``: floor(rate) plus one Bernoulli copy with the fraction's probability.

    rate = target / source_size, 0 where the source has no words. The Bernoulli copy is a draw from the seed and the
    row's key against a limit of its source (see _limits). Rows of one key share a draw; reruns agree. An empty input
    gives an empty result. Columns of rows may have any names; those named as the new ones are replaced.

    Sources and their limits are aggregates, so rows stay where they lie; the table of sources is broadcast up to
    BROADCAST_SOURCES rows.
    """
    names = rows.columns
    drawn = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(source).alias("_src"), F.col(size).cast("long").alias("_size"), uniform(seed, key).alias("_u"))
    narrow = cut(drawn.select("_src", "_size", "_u"), "draws")
    targets = source_targets(narrow, "_src", "_size", cap).withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(F.lit(0.0)))
    targets = cut(targets.withColumnRenamed("source", "_source"), "targets")
    small = targets.count() <= BROADCAST_SOURCES

    def told(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    per = narrow.join(told(targets), F.col("_src").eqNullSafe(F.col("_source"))).where("_size > 0 AND rate > floor(rate)")
    limits = _limits(per.select(F.col("_src").alias("source"), F.col("_size").alias("size"), F.col("_u").alias("u"), (F.col("rate") - F.floor("rate")).alias("part"), "source_size"))
    limits = limits.withColumnRenamed("source", "_limited")
    plan = cut(targets.join(limits, F.col("_source").eqNullSafe(F.col("_limited")), "left").drop("_limited"), "plan")
    discard(narrow, targets)
    joined = drawn.join(told(plan), F.col("_src").eqNullSafe(F.col("_source")))
    takes = F.when(F.col("_size") * LARGE > F.col("source_size"), F.array_contains("extra", F.col("_u"))).otherwise(F.col("_u") < F.col("limit"))
    copies = (F.floor("rate") + F.when(takes, 1).otherwise(0)).cast("int").alias("copies")
    new = ["source_size", "target", "rate", "copies"]
    return joined.select(*[F.col("_row").getField(c).alias(c) for c in names if c not in new], "source_size", "target", "rate", copies)


def _key() -> Column:
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs. Null text has size 0; a source without words takes none.

    Draws follow from doc_id and text, so rows that repeat both share one.
    """
    sizes = cut(docs.select("doc_id", F.col("source").alias("_src"), word_count(F.col("text")).alias("size"), _key().alias("_key")), "sizes")
    out = mix(sizes, "_src", "size", F.col("_key"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; rows that it takes no time are gone."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_docs_row"), F.col("source").alias("_docs_src"), word_count(F.col("text")).alias("_docs_size"), _key().alias("_docs_key"))
    out = mix(rows, "_docs_src", "_docs_size", F.col("_docs_key"))
    return out.where("copies > 0").select("_docs_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_docs_row.*")
