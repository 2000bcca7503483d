"""Minimax contiguous sharding: whole groups, kept in their order, go to shards whose largest size is as small as can be."""

from __future__ import annotations

import bisect
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.scratch import cut, ordered_prefix, shuffle_parts

#: Buckets into which each refinement of the prefix-sum axis is divided; what the driver holds is a multiple of this.
FAN = 2048


class _Axis:
    """Lookups "last group end at or below x" against a summary that is refined only where an answer needs it.

    The axis of prefix sums 0..total is divided into FAN equal buckets; one Spark aggregate gives each bucket's smallest
    and largest group end. A bucket that a lookup falls inside is divided again by the next refinement.
    """

    def __init__(self, ends: DataFrame, total: int):
        self.ends, self.total = ends, total
        self.leaves: list[tuple[int, int, int, int]] = []  # lower, upper bound of the bucket, smallest and largest end in it
        self._read([(0, total + 1)])

    def _read(self, spans: list[tuple[int, int]]) -> None:
        span = bucket = F.lit(None).cast("long")
        widths = [max(1, -(-(hi - lo) // FAN)) for lo, hi in spans]
        asked = []
        for i, (lo, hi) in enumerate(spans):
            inside = (F.col("end") >= F.lit(lo)) & (F.col("end") < F.lit(hi))
            asked.append(inside)
            span = F.when(inside, F.lit(i)).otherwise(span)
            bucket = F.when(inside, F.expr(f"(end - {lo}L) div {widths[i]}L")).otherwise(bucket)
        got = self.ends.where(reduce(Column.__or__, asked)).select("end", span.alias("i"), bucket.alias("k")).groupBy("i", "k").agg(F.min("end").alias("a"), F.max("end").alias("z")).collect()
        rows = [(spans[r.i][0] + r.k * widths[r.i], min(spans[r.i][1], spans[r.i][0] + (r.k + 1) * widths[r.i]), r.a, r.z) for r in got]
        drop = set(spans)
        self.leaves = sorted([x for x in self.leaves if (x[0], x[1]) not in drop] + rows)

    def lookup(self, x: int) -> tuple[int, int, tuple[int, int] | None]:
        """Least and greatest value that the answer can have, and the bucket to refine if they differ."""
        k = bisect.bisect_right(self.leaves, (x, float("inf"), 0, 0)) - 1
        while k >= 0:
            lo, hi, a, z = self.leaves[k]
            if a <= x:
                if z <= x:
                    return z, z, None
                return a, x, (lo, hi)
            k -= 1
        return 0, 0, None

    def above(self, x: int) -> tuple[int, tuple[int, int] | None]:
        """A group end at or above x, the first that the summary tells, and the bucket to refine if an earlier one may exist."""
        k = max(0, bisect.bisect_right(self.leaves, (x, float("inf"), 0, 0)) - 1)
        for lo, hi, a, z in self.leaves[k:]:
            if z >= x:
                return (a, None) if a >= x else (z, (lo, hi))
        return self.total, None

    def nearest(self, x: float, lo: int, hi: int) -> tuple[int, tuple[int, int] | None]:
        """The known group end in lo..hi that is nearest to x, and the bucket that x falls inside, if any."""
        k = max(0, bisect.bisect_right(self.leaves, (x, float("inf"), 0, 0)) - 1)
        inside = (self.leaves[k][0], self.leaves[k][1]) if self.leaves and self.leaves[k][2] < x < self.leaves[k][3] else None
        known = [e for leaf in self.leaves for e in leaf[2:] if lo <= e <= hi]
        return min(known, key=lambda e: (abs(e - x), e), default=lo), inside

    def refine(self, spans: set[tuple[int, int]]) -> None:
        self._read(sorted(spans))


def _cuts(axis: _Axis, capacity: int, shards: int) -> tuple[bool | None, list[int], set[tuple[int, int]]]:
    """Greedy check: fills each shard up to the capacity. None if the summary is too coarse to tell."""
    low = high = 0
    cuts, open_spans = [], set()
    for _ in range(shards):
        a, _, span_a = axis.lookup(low + capacity)
        _, b, span_b = axis.lookup(high + capacity)
        open_spans |= {s for s in (span_a, span_b) if s}
        low, high = a, b
        cuts.append(high)
    if low >= axis.total:
        return True, cuts, open_spans
    return (False if high < axis.total else None), cuts, open_spans


def _solve(ends: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """Ends of the shards for the smallest feasible capacity."""
    axis = _Axis(ends, total)
    lo, hi = max(largest, -(-total // shards)), total  # hi is always feasible
    while lo < hi:
        mid = (lo + hi) // 2
        fits, _, spans = _cuts(axis, mid, shards)
        if fits is None:
            axis.refine(spans)
        elif fits:
            hi = mid
        else:
            lo = mid + 1
    return _balanced(axis, hi, shards)


def _balanced(axis: _Axis, capacity: int, shards: int) -> list[int]:
    """Ends of the shards that come as near to equal sizes as the capacity and whole groups allow.

    Each cut aims at an equal share of what is left. It may lie no earlier than where the rest still fits into the
    shards left at this capacity, and it leaves a group for each of them where there are so many.
    """
    total = axis.total
    while True:  # floors[k]: the least end of shard k from which the later shards can take the rest
        floors, spans = [total], set()
        for _ in range(shards - 1):
            at, span = axis.above(floors[-1] - capacity) if floors[-1] > capacity else (0, None)
            floors.append(at)
            spans |= {span} if span else set()
        if floors[-1] <= capacity or not spans:
            break
        axis.refine(spans)
    floors = floors[::-1]
    last = [0, *(r.end for r in axis.ends.where(F.col("end") < total).orderBy(F.col("end").desc()).limit(shards - 1).collect()[::-1])] if shards > 1 else []
    cuts, at = [], 0
    for k in range(shards - 1):
        left = shards - k
        aim = at + (total - at) / left
        while True:
            first, _ = axis.above(at + 1)
            most = last[-(left - 1)] if len(last) > left - 1 else total
            lo = max(floors[k], min(first, total))
            hi = max(lo, min(at + capacity, most))
            end, inside = axis.nearest(aim, lo, hi)
            if not inside or inside[1] - inside[0] <= max(1, capacity // 1000):
                break
            axis.refine({inside})
        at = max(at, end)
        cuts.append(at)
    return [*cuts, total]


def minimax_shards(df: DataFrame, group: list[Column], size: Column, order: Column, shards: int, slot_key: list[Column]) -> DataFrame:
    """df with ``shard`` (0..shards-1) and ``slot`` (0, 1, ... inside each shard), rows of one group always together.

    Groups are ordered by their smallest ``order`` value (ties by the group key) and the sequence is cut into
    ``shards`` contiguous runs whose largest total size is the least possible: the capacity is found by binary search,
    each candidate checked greedily. Inside that capacity the cuts come near to equal sizes, and no shard is empty where
    there are groups enough for the rest. Columns of df may have any names; those named ``shard`` or ``slot`` are
    replaced.
    Slots are a seeded shuffle inside the shard (by hash of slot_key). An empty df gives an empty result; null
    order values come first; repeated rows are separate rows of one group.

    Shuffles: one aggregate to groups (pre-aggregated, so a hot group costs one row per task), one range partition of
    the groups, one join of the narrow rows to their groups, one window over (shard, hash bucket).
    """
    spark = df.sparkSession
    keys = [f"_g{i}" for i in range(len(group))]
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(k) for c, k in zip(group, keys, strict=True)], size.alias("_size"), order.alias("_order"), F.xxhash64(*slot_key).alias("_slot_key"))
    groups = base.groupBy(*keys).agg(F.sum("_size").alias("_w"), F.min("_order").alias("_first"))
    placed = cut(ordered_prefix(groups, ["_first", *keys], ["_w"], "groups").select(*keys, "_w", (F.col("_w_before") + F.col("_w")).cast("long").alias("end")), "placed")
    total, largest = placed.agg(F.max("end"), F.max("_w")).first()
    ends = _solve(placed.select("end"), total, largest, shards) if total else [0] * shards
    inner = ends[:-1]
    shard = F.lit(0)
    for e in inner:
        shard = shard + F.when(F.col("end") > F.lit(e), 1).otherwise(0)
    owner = placed.select(*keys, shard.cast("int").alias("shard"))
    n = shuffle_parts(spark)
    rows = base.join(owner, keys).drop(*keys).withColumn("_bucket", F.pmod(F.col("_slot_key"), F.lit(n)).cast("int"))
    rows = cut(rows, "sharded")
    filled = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))  # at most shards x n rows
    offsets = filled.select("shard", "_bucket", F.expr("coalesce(sum(_n) OVER (PARTITION BY shard ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)").alias("_before"))
    numbered = rows.withColumn("_rn", F.expr("row_number() OVER (PARTITION BY shard, _bucket ORDER BY _slot_key, _order, _size) - 1"))
    return numbered.join(F.broadcast(offsets), ["shard", "_bucket"]).select(*[F.col("_row").getField(c).alias(c) for c in df.columns if c not in ("shard", "slot")], "shard", (F.col("_before") + F.col("_rn")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law 'bytes', shard, slot, grown_shard for each row of docs.

    Equal texts share a shard; a null text counts as an empty one (size 1, CRC 0). Texts are told apart by 128 bits of
    hash. Null or repeated doc_ids are allowed. The narrow rows are written once, so texts are read once and never shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = cut(docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")), "narrow")
    out = minimax_shards(narrow, [F.col("h1"), F.col("h2")], F.col("size"), F.col("doc_id"), shards, [F.col("doc_id"), F.col("h1")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
