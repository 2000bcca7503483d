"""Near-duplicate embeddings: p-stable Euclidean hashing of normalised vectors, then exact cosine inside each bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.scratch import connected_components
from tessera.scratch import cut, discard, shuffle_parts

#: Rows of one side of a block of a bucket; a bucket of n rows is compared in about (n / BLOCK)**2 / 2 separate groups.
BLOCK = 256


def collision_chance(distance: float, width: float) -> float:
    """Chance that one quantised projection puts two vectors at this distance into one cell (Datar et al., 2004)."""
    from math import erf, exp, pi, sqrt

    r = width / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def expected_recall(cosine: float, tables: int, bits: int, width: float) -> float:
    return 1 - (1 - collision_chance((2 - 2 * cosine) ** 0.5, width) ** bits) ** tables


def _signatures(batches: Iterator[pa.RecordBatch], tables: int, bits: int, width: float, seed: int) -> Iterator[pa.RecordBatch]:
    planes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(dims)
        out = np.zeros((len(dims), tables), np.int64)
        for dim in np.unique(dims):
            if dim not in planes:
                rng = np.random.default_rng([seed, int(dim)])
                planes[dim] = rng.standard_normal((dim, tables * bits)), rng.uniform(0, width, tables * bits), rng.integers(1, 2**62, bits) * 2 + 1
            a, b, odd = planes[dim]
            rows = np.flatnonzero(dims == dim)
            x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
            x /= np.sqrt((x * x).sum(1))[:, None]
            cells = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(rows), tables, bits)
            with np.errstate(over="ignore"):
                out[rows] = (cells * odd).sum(2)
        sigs = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables, dtype=np.int32)), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("rep", "weight", "label", "dim", "embedding")] + [sigs], ["rep", "weight", "label", "dim", "embedding", "sigs"])


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of each (bucket, block pair); the rows of one come together. Gives (rep, links, root): never a row for each pair."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows).combine_chunks()
        n, dim = t.num_rows, t["dim"][0].as_py()
        if n < 2:
            return None
        bi, bj, mine, table = t["bi"][0].as_py(), t["bj"][0].as_py(), t["block"].to_numpy(), t["t"][0].as_py()
        x = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dim)
        sigs = t["sigs"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        rep, weight, norm = t["rep"].to_numpy(), t["weight"].to_numpy(), np.sqrt((x * x).sum(1))
        left = np.flatnonzero(mine == bi)
        right = left if bi == bj else np.flatnonzero(mine == bj)
        if not len(left) or not len(right):
            return None
        cosine = (x[left] @ x[right].T) / (norm[left][:, None] * norm[right][None, :])
        i, j = np.nonzero(cosine >= threshold)
        i, j = left[i], right[j]
        keep = (i < j) if bi == bj else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        if not len(i):
            return None
        fresh = ~(sigs[i, :table] == sigs[j, :table]).any(1)  # counted in the first table in which the pair meets
        links = np.zeros(n, np.int64)
        np.add.at(links, i[fresh], weight[j[fresh]])
        np.add.at(links, j[fresh], weight[i[fresh]])
        root = rep.copy()
        while True:  # smallest label over the links until nothing changes
            was = root.copy()
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
            if (was == root).all():
                break
        some = np.flatnonzero((links > 0) | (root != rep))
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(root[some])], ["rep", "links", "root"]) if len(some) else None

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("key", "bi", "bj")], 1)
        if not len(keys):
            continue
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for s, e in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if held and tuple(keys[s]) != now:
                if (out := solve(held)) is not None:
                    yield out
                held = []
            now = tuple(keys[s])
            held.append(batch.slice(s, e - s))
    if held and (out := solve(held)) is not None:
        yield out


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tables: int = 20, bits: int = 8, width: float = 1.0, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Two vectors link when their labels are equal and not null, their lengths are equal and their cosine in double
    precision is at least the threshold. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing. Candidates share a cell of ``bits`` quantised Gaussian projections in one of ``tables`` tables; with the
    default parameters a pair at cosine 0.98 is found with chance expected_recall() = 0.997, a closer pair with more.
    Every candidate is checked exactly. Rows with equal label and components are one weighted vector, told apart by 128
    bits of hash, each linked with the others. Repeated vec_ids are separate vectors: each row gets the links of its own
    vector, and its component is the smallest id reached by that vector. A vector with a null vec_id links with nothing.
    Components keep the input's precision (float or double).

    A bucket is cut into blocks of BLOCK rows by hash and each pair of blocks is its own group, so no task holds a whole
    bucket; a pair is counted in the first table in which it meets. Links leave a group as counts and roots, not as pairs.
    """
    spark = vectors.sparkSession
    given = vectors.schema["embedding"].dataType
    kind = "float" if isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType) else "double"
    number = F.coalesce(F.col("embedding").cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(number) > 0) & ~F.exists(number, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(number, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), number.alias("embedding"), F.coalesce(usable, F.lit(False)).alias("_usable"))
    rows = rows.select("*", F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit("second"), "label", "embedding").alias("h2"))
    able = rows.where("_usable")
    same = able.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    # A number for each distinct vector; it is written, so it stays the same in all that follows.
    same = cut(same.select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "least", "weight", "label", F.size("embedding").alias("dim"), "embedding"), "same")
    kinds = f"rep long, weight long, label string, dim int, embedding array<{kind}>, sigs array<long>"
    hashed = cut(same.select("rep", "weight", "label", "dim", "embedding").mapInArrow(lambda b: _signatures(b, tables, bits, width, seed), kinds), "vectors")

    bucketed = hashed.select("rep", "label", "dim", F.posexplode("sigs").alias("t", "_sig")).select("rep", "t", F.xxhash64("t", "label", "dim", "_sig").alias("key"))
    counts = cut(bucketed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    placed = bucketed.join(counts, "key").select("rep", "t", "key", blocks.alias("c"), F.pmod(F.xxhash64("rep", "key"), blocks).cast("int").alias("block"))
    spread = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).select("rep", "t", "key", "block", F.least("block", "_other").alias("bi"), F.greatest("block", "_other").alias("bj"))
    wide = spread.join(hashed.drop("label"), "rep").repartition(shuffle_parts(spark), "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    found = cut(wide.select("key", "bi", "bj", "block", "t", "dim", "rep", "weight", "embedding", "sigs").mapInArrow(lambda b: _compare(b, threshold), "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("_links"))
    comps = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    reps = same.select("rep", "h1", "h2", "least", "weight").join(links, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    reps = cut(reps.select("h1", "h2", "least", (F.coalesce("_links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("comp")), "reps")
    named = cut(reps.join(reps.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("h1", "h2", "n_links", "component_id"), "named")
    discard(same, hashed, counts, found, comps, reps)

    linked = able.select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT _usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
