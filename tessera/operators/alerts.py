"""Alert rules as a table, evaluated for all entities in one job; rule types are found by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import cut, ordered_prefix

_OUT = ["rule_id", "entity", "value", "threshold"]


#: Rules of one page of the index.
PAGE = 1000


@dataclass(frozen=True)
class Rule:
    """How a rule type is decided from an entity's last ``length`` rows: its value, its threshold and whether it hits, as SQL.

    They may use: z, a (newest and oldest price), mean, hi, lo (of the prices before the newest), q (newest quantity),
    q_mean (of the quantities before) and the rule's p1 and p2. ``measure`` and ``limit`` say the same for the index: no
    rule hits whose limit, which depends on the rule alone, is above the measure, which depends on the entity alone.
    """

    length: str
    value: str
    threshold: str
    hit: str
    measure: str
    limit: str


_CHANGE = "100 * try_divide(z - a, a)"
#: Rule types and how they are evaluated: W29 levels, W30 changes over p2 rows, W31 means of p1 rows, W32 highs and lows of p1 rows, W33 quantities against p1 times the mean of the p2 rows before.
DISPATCH: dict[str, Rule] = {
    "price_above": Rule("1", "z", "p1", "value > threshold", "z", "p1"),
    "price_below": Rule("1", "z", "p1", "value < threshold", "-z", "-p1"),
    "pct_above": Rule("p2 + 1", _CHANGE, "p1", "value >= threshold", _CHANGE, "p1"),
    "pct_below": Rule("p2 + 1", _CHANGE, "p1", "value <= threshold", f"-({_CHANGE})", "-p1"),
    "sma_above": Rule("p1", "z", "mean", "value > threshold", "z - mean", "0D"),
    "sma_below": Rule("p1", "z", "mean", "value < threshold", "mean - z", "0D"),
    "new_high": Rule("p1", "z", "hi", "value >= threshold", "z - hi", "0D"),
    "new_low": Rule("p1", "z", "lo", "value <= threshold", "lo - z", "0D"),
    "volume_spike": Rule("p2 + 1", "q", "p1 * q_mean", "value > 0 AND q_mean > 0 AND value >= threshold", "CASE WHEN q > 0 AND q_mean > 0 THEN (q / q_mean) * 1.000000000001D END", "p1"),
}


def _by_type(part: str) -> Column:
    return F.expr("CASE rule_type " + " ".join(f"WHEN '{name}' THEN {getattr(rule, part)}" for name, rule in DISPATCH.items()) + " END")


@dataclass(frozen=True)
class RuleIndex:
    """Rules sorted by limit under equal keys, in pages of at most PAGE: (keys, _page, _rules) and, for each key, the least limit of every page (keys, _lows)."""

    keys: list[str]
    pages: DataFrame
    directory: DataFrame

    def search(self, values: DataFrame, measure: str) -> DataFrame:
        """values (which hold the keys and the measure) with the fields of every rule whose limit is at most the measure.

        A value reads the directory of its key, then the pages that begin at or below it: all but the last hold hits
        only, so the work follows the hits.
        """
        found = values.where(F.col(measure).isNotNull()).join(self.directory, self.keys)
        reach = F.size(F.filter("_lows", lambda x: x <= F.col(measure)))
        each = found.withColumn("_reach", reach).where("_reach > 0").withColumn("_page", F.explode(F.sequence(F.lit(0), F.col("_reach") - 1))).drop("_lows", "_reach")
        hit = each.join(self.pages, [*self.keys, "_page"]).withColumn("_rule", F.explode(F.filter("_rules", lambda r: r["_limit"] <= F.col(measure))))
        return hit.select(*values.columns, *[F.col("_rule").getField(f.name).alias(f.name) for f in self.pages.schema["_rules"].dataType.elementType.fields if f.name != "_limit"])


def rule_index(rules: DataFrame, keys: list[str], limit: Column, fields: list[str]) -> RuleIndex:
    """The index of a table of rules; rules without a limit are left out. Rules are put in order over range partitions, so there may be any number of them."""
    sized = rules.select(*keys, *fields, limit.cast("double").alias("_limit")).where("_limit IS NOT NULL AND NOT isnan(_limit)")
    placed = cut(ordered_prefix(sized, [*keys, "_limit", *fields], [], "rules"), "rules")
    first = placed.groupBy(*keys).agg(F.min("pos").alias("_first"))
    page = F.floor((F.col("pos") - F.col("_first")) / PAGE).cast("int")
    pages = placed.join(first, keys).withColumn("_page", page).groupBy(*keys, "_page").agg(F.min("_limit").alias("_low"), F.collect_list(F.struct("_limit", *fields)).alias("_rules"))
    pages = cut(pages, "pages")
    return RuleIndex(keys, pages.drop("_low"), cut(pages.groupBy(*keys).agg(F.sort_array(F.collect_list("_low")).alias("_lows")), "directory"))


def measures(panel: DataFrame, lengths: list[int]) -> DataFrame:
    """(entity, _len, z, a, mean, hi, lo, q, q_mean) over each entity's newest rows for each length that it has so many rows for."""
    tail = panel.select("entity", "date", "price", "qty", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("date"))).alias("_rn")).where(F.col("_rn") <= max(lengths, default=0))
    each = tail.withColumn("_len", F.explode(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n >= F.col("_rn"))))
    early = lambda c: F.when(F.col("_rn") > 1, F.col(c))
    g = each.groupBy("entity", "_len").agg(F.count(F.lit(1)).alias("_n"), F.max_by("price", "date").alias("z"), F.min_by("price", "date").alias("a"), F.avg("price").alias("mean"), F.max(early("price")).alias("hi"), F.min(early("price")).alias("lo"), F.max_by("qty", "date").alias("q"), F.avg(early("qty")).alias("q_mean"))
    return g.where("_n = _len").drop("_n")


def evaluate(rules: DataFrame, panel: DataFrame) -> DataFrame:
    """Rules (rule_id, rule_type, target, p1, p2) met by the newest rows of panel (entity, date, price, qty); target '*' names all entities.

    Each entity is measured once for each length that rules read (there are at most as many as the longest has rows).
    Rules with a target meet their entity by name; those for all are found by their limits in an index, so 100,000 rules
    that don't hit cost one search per entity, type and length. An entity with fewer rows than a rule needs has no result
    for it.
    """
    sized = rules.where(F.col("rule_type").isin(*DISPATCH)).select("rule_id", "rule_type", F.col("target").alias("_target"), "p1", "p2", _by_type("length").cast("int").alias("_len")).where("_len >= 1")
    sized = cut(sized, "rules")
    m = measures(panel, sorted(r[0] for r in sized.select("_len").distinct().collect()))
    named = m.withColumn("_target", F.col("entity").cast("string")).join(sized.where("_target <> '*'"), ["_target", "_len"]).drop("_target")
    index = rule_index(sized.where("_target = '*'"), ["rule_type", "_len"], _by_type("limit"), ["rule_id", "p1", "p2"])
    types = index.directory.select("_len", "rule_type")
    general = index.search(m.join(types, "_len").withColumn("_measure", _by_type("measure")), "_measure").drop("_measure")
    both = named.unionByName(general).withColumn("value", _by_type("value")).withColumn("threshold", _by_type("threshold"))
    return both.where(_by_type("hit")).select(*_OUT)


#: A condition in terms of the index: what grows where it is met, and from which limit on.
_SIGNED = {"<=": ("-v", "-t"), "<": ("-v", "-t"), ">=": ("v", "t"), ">": ("v", "t")}
#: Two values are equal within this.
SAME = 1e-9


def conditions(rules: DataFrame, metrics: DataFrame, names: list[str]) -> DataFrame:
    """Conditions such as ``ev<=9;pb<1.5`` met by an entity's metrics: all or any by ``match``, and the share met. A null metric fails; conditions on metrics that aren't named don't count.

    Met conditions are found in an index of their limits, equalities by cells of the value; what isn't met costs nothing.
    """
    one = rules.select("rule_id", "match", F.posexplode(F.split("conditions", ";")).alias("_i", "c")).where("trim(c) <> ''")
    part = lambda k: F.regexp_extract(F.trim("c"), r"^(\w+)\s*(<=|>=|==|<|>)\s*(-?[0-9.]+)$", k)
    one = cut(one.select("rule_id", "match", "_i", part(1).alias("metric"), part(2).alias("op"), part(3).try_cast("double").alias("t")).where(F.col("metric").isin(*names)), "conditions")
    v = metrics.unpivot("entity", names, "metric", "v").where("v IS NOT NULL")
    signed = lambda k: F.expr("CASE op " + " ".join(f"WHEN '{op}' THEN {e[k]}" for op, e in _SIGNED.items()) + " END")
    index = rule_index(one.where("op <> '=='"), ["metric", "op"], signed(1), ["rule_id", "_i", "t"])
    ops = index.directory.select("metric", "op")
    met = index.search(v.join(ops, "metric").withColumn("_measure", signed(0)), "_measure").where("CASE op WHEN '<' THEN v < t WHEN '>' THEN v > t ELSE true END").select("entity", "rule_id", "_i")
    cell = lambda c: F.floor(F.col(c) * 1e6)
    equal = one.where("op = '=='").withColumn("_cell", F.explode(F.array(cell("t") - 1, cell("t"), cell("t") + 1)))
    same = v.withColumn("_cell", cell("v")).join(equal, ["metric", "_cell"]).where(F.abs(F.col("v") - F.col("t")) < SAME).select("entity", "rule_id", "_i")
    size = one.groupBy("rule_id", "match").agg(F.count(F.lit(1)).alias("_all"))
    g = met.unionByName(same).groupBy("rule_id", "entity").agg(F.count(F.lit(1)).alias("_met")).join(size, "rule_id")
    return g.where(F.when(F.col("match") == "all", F.col("_met") == F.col("_all")).otherwise(True)).select("rule_id", "entity", (F.col("_met") / F.col("_all")).alias("value"), F.lit(1.0).alias("threshold"))


def run(rules: DataFrame, panel: DataFrame, priority: str | None = None, target: str | None = None, at: str | None = None) -> DataFrame:
    """The enabled rules of the table, filtered by priority and target, in one evaluation; with ``at``, a column run_at of that time for the log."""
    rules = rules.where("enabled")
    if priority:
        rules = rules.where(F.col("priority") == priority)
    if target:
        rules = rules.where(F.col("target").isin(target, "*"))
    out = evaluate(rules, panel)
    return out.withColumn("run_at", F.lit(at).cast("timestamp")) if at else out


def append_log(hits: DataFrame, path: str) -> None:
    """W35, the log: hits with their run_at behind those of earlier runs."""
    hits.write.mode("append").parquet(path)
