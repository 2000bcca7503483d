"""Bit filters over hashes and connected components."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.scratch import cut, discard

#: Bits of a filter over hashes; a full filter only costs time.
FILTER_BITS = 1 << 26


def bit_filter(hashes: DataFrame, column: str) -> Broadcast:
    """A bit for each of FILTER_BITS values of the hashes, merged in Spark and broadcast: 8 MB, however many hashes there are."""
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS)) + 1
    maps = hashes.select(bit.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m")).collect()
    held = np.zeros(FILTER_BITS // 8 + 4096, np.uint8)
    for r in maps:
        held[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.m), np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(held)


def may_hold(told: Broadcast, hashes: np.ndarray) -> np.ndarray:
    """True for every hash that the filter was made of, and for few others while it is sparse."""
    h = hashes.astype(np.int64) % FILTER_BITS
    return (told.value[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1


#: Edges from which a vertex counts as a hub, where that is more than a thousandth of all; so there are at most 2,000 hubs.
HUB_EDGES = 1000


def _lowest(rows: DataFrame, low: DataFrame, least: int) -> DataFrame:
    """rows (u, v) with m from low (u, m, d), u's row. Hubs, of which there are at most 2,000, are broadcast, so that their many rows stay where they lie."""
    hubs = low.where(F.col("d") >= least).select("u", F.col("m").alias("_hub"))
    marked = rows.join(F.broadcast(hubs), "u", "left")
    others = marked.where("_hub IS NULL").drop("_hub").join(low.where(F.col("d") < least).drop("d"), "u")
    return marked.where("_hub IS NOT NULL").select("u", "v", F.col("_hub").alias("m")).unionByName(others)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for each id that an edge names, the smallest id it can be reached from.

    Alternates large-star and small-star rounds (Kiveris et al., 2014) until the edges stay the same. Minima are
    aggregated before the shuffle; a vertex of very many edges gets its minimum by broadcast, so its edges never meet in
    one task. Each round's tables are deleted when the next ones are whole.
    """
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        least = max(HUB_EDGES, mark[0] // 1000)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d")).select("u", F.least("u", "m").alias("m"), "d"), "low")
        large = cut(_lowest(both, low, least).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        lower = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d")), "low")
        small = _lowest(large, lower, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(now, low, large, lower)
        now = after
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = cut(stars.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct(), "components")
    discard(now)
    return out
