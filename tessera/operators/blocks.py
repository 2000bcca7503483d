"""Statistics of all entity pairs of a group as products of dense blocks.

Each entity's series is packed into one row. The series of a group are dealt into blocks of bounded size, and every
pair of blocks is one task's work: two matrices (entity x time, with a mask of what is given) whose products are the
counts, sums and cross sums of all their pairs at once. No row per pair and time exists; what is shuffled is each series
once for every block of its group. An entity has one value for a time; null and NaN are missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.arrays import corr_p_value, round_half_up, unit_root_p
from tessera.functions.columns import div
from tessera.operators import pairs
from tessera.operators.grouped import Layout, lead_lag_f
from tessera.operators.keys import meet
from tessera.scratch import cut

#: Series that a kernel takes of a side, and values of one block; a task holds two blocks and about ten matrices of a kernel's pairs. Each series is shuffled once for every block of its group.
BLOCK_SERIES = 512
BLOCK_VALUES = 1 << 20
#: Block pairs that all groups together are cut into, about, beyond which blocks get larger instead of more, so that a series is shuffled no more often as tables grow.
BLOCK_PAIRS = 1000
#: Tasks that block pairs are dealt over, at most.
BLOCK_TASKS = 4096
#: Series with the same times from which on they are computed as one tile, and values of a tile's largest array.
TILE_SERIES = 4
TILE_VALUES = 1 << 21
#: Values that the rows of one part of a kernel hold, about: arrays of so many stay in a core's cache, and below what workers map anew for each array.
PART_VALUES = 1 << 16
#: Series of a group with the same times from which on sums over its pairs are taken from sums over series; series of one such sum at most.
SHARED_SERIES = 64
SHARED_CHUNK = 2048
#: Variance below this share of the mean square counts as none: it is what rounding leaves of a constant series.
FLAT = 1e-12
#: The same as a share of the sum of squares of the values themselves.
ROUNDED = 1e-28


@dataclass
class BlockPair:
    """Series x (of a) and y (of b) over common times, NaN where missing; ``wanted`` marks the pairs that this block pair answers for."""

    a: np.ndarray
    b: np.ndarray
    times: np.ndarray
    x: np.ndarray
    y: np.ndarray
    wanted: np.ndarray

    def names(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smaller and the larger entity of each pair and whether they changed places."""
        turned = self.a[i] > self.b[j]
        return np.where(turned, self.b[j], self.a[i]), np.where(turned, self.a[i], self.b[j]), turned

    def row(self, i: int, j: np.ndarray, columns: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The common values (x, y) of series i of a and each of j of b in the given columns of times, moved to the front, with the mask and the columns of what is there."""
        x, y = self.x[i, columns], self.y[:, columns][j]
        own = np.flatnonzero(~np.isnan(x))
        common = ~np.isnan(y[:, own])
        if common.all():  # nothing to move
            return np.broadcast_to(x[own], common.shape), y[:, own], common, np.broadcast_to(own, common.shape)
        count = common.sum(1)
        most = int(count.max(initial=0))
        r, c = np.nonzero(common)
        k = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        at, vx, vy = np.zeros((len(j), most), np.int64), np.zeros((len(j), most)), np.zeros((len(j), most))
        at[r, k], vx[r, k], vy[r, k] = own[c], x[own[c]], y[r, own[c]]
        return vx, vy, np.arange(most) < count[:, None], at

    def rows(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each series of a: its number, those of its partners, and what ``row`` gives of them; all wanted pairs or those given."""
        wanted = self.wanted if wanted is None else wanted
        for i in np.flatnonzero(wanted.any(1)):
            j = np.flatnonzero(wanted[i])
            yield i, j, *self.row(i, j)

    def tiles(self) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """Tiles (i, j, columns) of pairs that have just these columns in common, and the mask of the wanted pairs outside them.

        Series with values at the same times make a class, and the pairs of two classes a tile; pairs of two classes with
        few series are left to ``rows``. Of a block with itself the pairs of two classes lie in two tiles, each half wanted.
        """
        a, b = _classes(self.x), _classes(self.y)
        few_a, few_b = (np.zeros(n, bool) for n in self.wanted.shape)
        for few, classes in ((few_a, a), (few_b, b)):
            for k in classes:
                few[k] = len(k) < TILE_SERIES
        there_a, there_b = ([~np.isnan(v[k[0]]) for k in classes] for v, classes in ((self.x, a), (self.y, b)))
        tiles = [(i, j, np.flatnonzero(ta & tb)) for i, ta in zip(a, there_a, strict=True) for j, tb in zip(b, there_b, strict=True) if not (few_a[i[0]] and few_b[j[0]])]
        return tiles, self.wanted & few_a[:, None] & few_b[None, :]

    def cells(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The wanted pairs of a tile: their rows and columns in it, both names and whether they changed places."""
        r, c = np.nonzero(self.wanted[np.ix_(i, j)])
        return r, c, *self.names(i[r], j[c])


def _classes(x: np.ndarray) -> list[np.ndarray]:
    """Numbers of the series that have values at the same times."""
    _, of = np.unique(np.packbits(~np.isnan(x), axis=1), axis=0, return_inverse=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(of[order])) + 1)


Rows = dict[str, np.ndarray | pa.Array]
#: A kernel gives its rows at once or in parts, where all of them are many.
Kernel = Callable[[BlockPair], Rows | Iterator[Rows]]


def _side(t: pa.Table, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entities of a block; series number, time and value of each of its values."""
    own = t.filter(pc.equal(t["_block"], block)).combine_chunks()
    series = own["_series"].combine_chunks() if isinstance(own["_series"], pa.ChunkedArray) else own["_series"]
    flat = series.flatten()
    return own["_entity"].to_numpy(), pc.list_parent_indices(series).to_numpy(), flat.field("t").to_numpy(zero_copy_only=False), flat.field("x").to_numpy(zero_copy_only=False)


@dataclass
class Dealt:
    """Series of a panel with their block, for any number of kernels."""

    series: DataFrame
    by: list[T.StructField]
    tasks: int


def over_blocks(panel: DataFrame, entity: str, time: str, x: str, by: list[str], kernel: Kernel, columns: list[T.StructField], digits: dict[str, int] | None = None) -> DataFrame:
    """The rows (by, columns) that the kernel makes of every pair of blocks of a group; columns of digits are rounded to so many."""
    return run_blocks(deal(panel, entity, time, x, by), kernel, columns, digits)


def deal(panel: DataFrame, entity: str, time: str, x: str, by: list[str]) -> Dealt:
    """Packs the series of a panel and deals those of a group into blocks."""
    return _dealt(_pack(panel, entity, time, x, by).withColumn("_shared", F.lit(False)), [panel.schema[c] for c in by])


def _pack(panel: DataFrame, entity: str, time: str, x: str, by: list[str]) -> DataFrame:
    given = panel.where(F.col(x).isNotNull() & ~F.isnan(x) & F.col(entity).isNotNull() & F.col(time).isNotNull())
    return cut(given.groupBy(*by, F.col(entity).alias("_entity")).agg(F.collect_list(F.struct(F.col(time).alias("t"), F.col(x).cast("double").alias("x"))).alias("_series")), "series")


def _dealt(series: DataFrame, fields: list[T.StructField]) -> Dealt:
    """Deals packed series into blocks; those marked as shared lie in blocks of their own, behind the others, whose pairs with each other are left out."""
    by = [f.name for f in fields]

    shared = F.col("_shared")
    told = [(F.count_if(which).alias(n), F.coalesce(F.sum(F.when(which, F.size("_series"))), F.lit(0)).alias(f"{n}_values")) for n, which in (("_n", ~shared), ("_m", shared))]
    sizes = series.groupBy(*by).agg(*[c for two in told for c in two])
    every = F.sum((F.col("_n") / 2 + F.col("_m")) * F.col("_n")).over(Window.partitionBy())  # pairs; a row for each group
    side = F.greatest(F.lit(float(BLOCK_SERIES)), F.sqrt(every / BLOCK_PAIRS))
    need = lambda n: F.greatest(F.ceil(F.col(n) / side), F.ceil(F.col(f"{n}_values") / BLOCK_VALUES)).cast("int")
    blocks = sizes.select(*by, need("_n").alias("_own"), need("_m").alias("_behind")).select(*by, "_own", (F.col("_own") + F.col("_behind")).alias("_blocks"))
    place = F.xxhash64("_entity")
    among = lambda n: F.pmod(place, F.greatest(n, F.lit(1)))
    block = F.when(shared, F.col("_own") + among(F.col("_blocks") - F.col("_own"))).otherwise(among(F.col("_own")))
    dealt = meet(series, blocks, by).withColumn("_block", block.cast("int"))
    # The series are few bytes for their work, so the number of tasks is that of block pairs: by bytes alone they would be joined into a few tasks.
    total = blocks.agg(F.sum(F.col("_own").cast("long") * (2 * F.col("_blocks") - F.col("_own") + 1) / 2)).first()[0] or 1
    return Dealt(dealt, fields, int(min(total, BLOCK_TASKS)))


def _parts(a: np.ndarray, b: np.ndarray, times: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> Iterator[BlockPair]:
    """A pair of blocks (or a block with itself: x is y) as pairs of parts of about so many series, each over the times that it has values at."""
    one, two = (np.array_split(np.arange(len(v)), max(1, round(len(v) / most))) for v in (a, b))
    two = one if x is y else two
    for k, i in enumerate(one):
        for j in two[k:] if x is y else two:
            own = x is y and i is j
            left = x[i]
            right = left if own else y[j]
            given = ~(np.isnan(left).all(0) & np.isnan(right).all(0))
            left = left[:, given]
            right = left if own else right[:, given]
            yield BlockPair(a[i], b[j], times[given], left, right, a[i][:, None] < b[j][None, :] if own else np.ones((len(i), len(j)), bool))


def run_blocks(dealt: Dealt, kernel: Kernel, columns: list[T.StructField], digits: dict[str, int] | None = None) -> DataFrame:
    """The rows (by, columns) that the kernel makes of every pair of blocks of the dealt series; columns of digits are rounded to so many."""
    by = [c.name for c in dealt.by]
    schema = T.StructType([*dealt.by, *columns])
    paired = dealt.series.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("_p", F.least("_block", "_other")).withColumn("_q", F.greatest("_block", "_other")).where("_p < _own")

    types = pa.schema([(f.name, _arrow(f.dataType)) for f in schema.fields])
    most = BLOCK_SERIES

    def rows_of(block: BlockPair) -> Iterator[Rows]:
        made = kernel(block) if block.wanted.any() else {}
        yield from [made] if isinstance(made, dict) else made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        p, q = t["_p"][0].as_py(), t["_q"][0].as_py()
        a, ai, at, ax = _side(t, p)
        b, bi, bt, bx = (a, ai, at, ax) if p == q else _side(t, q)
        times = np.unique(np.concatenate([at, bt]))
        left = np.full((len(a), len(times)), np.nan)
        left[ai, np.searchsorted(times, at)] = ax
        right = left
        if p != q:
            right = np.full((len(b), len(times)), np.nan)
            right[bi, np.searchsorted(times, bt)] = bx
        for out in (rows for block in _parts(a, b, times, left, right, most) for rows in rows_of(block)):
            n = len(next(iter(out.values()))) if out else 0
            if n:
                out = out | {c: round_half_up(out[c], k) for c, k in (digits or {}).items()}
                whole = {c: pa.repeat(t[c][0], n) for c in by} | {f.name: pa.array(out[f.name], types.field(f.name).type, from_pandas=True) for f in columns}
                yield pa.RecordBatch.from_arrays([whole[f.name].cast(f.type) for f in types], schema=types)

    return paired.repartition(dealt.tasks, *by, "_p", "_q").groupBy(*by, "_p", "_q").applyInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _pair_fields(panel: DataFrame, entity: str, **doubles: T.DataType) -> list[T.StructField]:
    kind = panel.schema[entity].dataType
    return [T.StructField("a", kind), T.StructField("b", kind), *(T.StructField(n, t) for n, t in doubles.items())]


def _moments(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """n, means, sample variances and covariance of each pair of rows over the columns that both have."""
    mx, my = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        cx, cy = (np.nan_to_num(np.nansum(v, 1) / m.sum(1))[:, None] for v, m in ((x, mx), (y, my)))  # sums about the mean lose no digits
        x0, y0 = np.where(mx > 0, x - cx, 0.0), np.where(my > 0, y - cy, 0.0)
        n, sx, sy = mx @ my.T, x0 @ my.T, mx @ y0.T
        sxx, syy, sxy = (x0 * x0) @ my.T, mx @ (y0 * y0).T, x0 @ y0.T
        vx, vy, c = (sxx - sx * sx / n) / (n - 1), (syy - sy * sy / n) / (n - 1), (sxy - sx * sy / n) / (n - 1)
        vx, vy = (np.where(v <= FLAT * (s / n + 1e-300), 0.0, v) for v, s in ((vx, sxx), (vy, syy)))
        return {"n": n, "mx": sx / n + cx, "my": sy / n + cy.T, "vx": vx, "vy": vy, "cov": c}


def _told(labels: DataFrame, time: str):
    """The name of the label's column and the broadcast times, codes and labels."""
    label = next(c for c in labels.columns if c != time)
    held = labels.select(time, label).distinct().toArrow()  # a row for each time and label
    values = held[label].combine_chunks().dictionary_encode()
    return label, labels.sparkSession.sparkContext.broadcast((held[time].to_numpy(), values.indices.to_numpy(), values.dictionary))


def _corr(m: dict[str, np.ndarray]) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((m["vx"] > 0) & (m["vy"] > 0), m["cov"] / np.sqrt(m["vx"] * m["vy"]), np.nan)


def pair_stats(panel: DataFrame, entity: str, time: str, x: str, by: list[str], least: int = 2, labels: DataFrame | None = None) -> DataFrame:
    """(by, a, b, n, corr, cov, beta, alpha) of each pair a < b with at least so many common times; beta and alpha regress b's values on a's.

    labels: (time, label), any number of labels for a time; then a row for each label of a pair, over the label's times.
    There are as many labels as times or windows of them, and they are sent to all tasks. corr and beta are null where a
    series is constant.
    """
    numbers = {"n": T.LongType()} | dict.fromkeys(("corr", "cov", "beta", "alpha"), T.DoubleType())
    fields = _pair_fields(panel, entity, **numbers)
    told = None
    if labels is not None:
        label, told = _told(labels, time)
        fields = [labels.schema[label], *fields]

    def rows(block: BlockPair, columns: np.ndarray | slice) -> dict[str, np.ndarray]:
        m = _moments(block.x[:, columns], block.y[:, columns])
        i, j = np.nonzero(block.wanted & (m["n"] >= max(least, 1)))
        first, second, turned = block.names(i, j)
        m = {k: v[i, j] for k, v in m.items()}
        vx, mx, my = np.where(turned, m["vy"], m["vx"]), np.where(turned, m["my"], m["mx"]), np.where(turned, m["mx"], m["my"])
        with np.errstate(invalid="ignore", divide="ignore"):
            beta = np.where(vx > 0, m["cov"] / vx, np.nan)
        return {"a": first, "b": second, "n": m["n"].astype(np.int64), "corr": _corr(m), "cov": m["cov"], "beta": beta, "alpha": my - beta * mx}

    def kernel(block: BlockPair) -> Iterator[Rows]:
        if told is None:
            yield rows(block, slice(None))
            return
        at, code, names = told.value
        for k in np.unique(code[np.isin(at, block.times)]):
            r = rows(block, np.isin(block.times, at[code == k]))
            yield r | {label: names.take(pa.array(np.full(len(r["n"]), k), pa.int64()))}

    return over_blocks(panel, entity, time, x, by, kernel, fields)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows about their mean, of length 1, so that products of rows are correlations; NaN where a row is constant."""
    d = x - x.mean(1, keepdims=True)
    size = (d * d).sum(1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(size > ROUNDED * (x * x).sum(1, keepdims=True), d / np.sqrt(size), np.nan)


def _window_units(x: np.ndarray, rows: int, part: slice = slice(None)) -> np.ndarray:
    """(window, series, row): the last ``rows`` values up to each place from place rows - 1 on, or up to a part of these places, as in ``_unit``."""
    x = x - x.mean(1, keepdims=True)
    w = np.lib.stride_tricks.sliding_window_view(x, rows, axis=1)[:, part]
    out = np.empty((w.shape[1], len(x), rows))
    step = max(1, PART_VALUES // max(w.shape[1] * rows, 1))
    for k in range(0, len(x), step):
        few = w[k : k + step]
        d = few - few.mean(2, keepdims=True)
        size = (d * d).sum(2, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            flat = size <= FLAT * (x[k : k + step] ** 2).sum(1)[:, None, None]
            out[:, k : k + step] = np.where(flat, np.nan, d / np.sqrt(size)).transpose(1, 0, 2)
    return out


def extreme_peers(panel: DataFrame, entity: str, time: str, x: str, by: list[str], least: int, most: int) -> DataFrame:
    """(by, target, peer, c): of each entity's partners with at least so many common times the ``most`` of largest and of smallest absolute correlation in each block, the smaller entity first among equals, null as if it were below all.

    So an entity has at most 2 * most rows for each block of its group, and the wanted ones of the group are among them.
    """
    kind = panel.schema[entity].dataType
    fields = [T.StructField("target", kind), T.StructField("peer", kind), T.StructField("c", T.DoubleType())]

    def best(targets: np.ndarray, peers: np.ndarray, c: np.ndarray, given: np.ndarray) -> Rows:
        order = np.argsort(peers, kind="stable")
        c, given, peers = c[:, order], given[:, order], peers[order]
        value = np.where(np.isnan(c), -1.0, c)
        chosen = np.zeros(c.shape, bool)
        for sign in (1.0, -1.0):
            left = np.where(given, sign * value, -np.inf)
            for _ in range(min(most, left.shape[1])):
                at = left.argmax(1)[:, None]
                found = np.take_along_axis(left, at, 1) > -np.inf
                np.put_along_axis(chosen, at, np.take_along_axis(chosen, at, 1) | found, 1)
                np.put_along_axis(left, at, -np.inf, 1)
        i, j = np.nonzero(chosen)
        return {"target": targets[i], "peer": peers[j], "c": c[i, j]}

    def kernel(block: BlockPair) -> Iterator[Rows]:
        m = _moments(block.x, block.y)
        c, given = np.abs(_corr(m)), m["n"] >= max(least, 1)
        if block.x is block.y:
            yield best(block.a, block.a, c, given & ~np.eye(len(block.a), dtype=bool))
        else:
            yield best(block.a, block.b, c, given)
            yield best(block.b, block.a, c.T, given.T)

    return over_blocks(panel, entity, time, x, by, kernel, fields)


#: Cells that one round cuts a cell of correlations into, as a power of two; rounds at most; values that a cell may have when they are put in order.
CELL_BITS, CELL_ROUNDS, CELL_VALUES = 9, 5, 100_000


def corr_quantiles(panel: DataFrame, entity: str, time: str, x: str, by: list[str], least: int, labels: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """(label, n, pairs, mean, one column for each name in wanted): over all pairs with at least so many common times of a label, how many there are, how many have a correlation, its mean and its exact quantiles, interpolated as by ``percentile``.

    No row of a pair leaves its task: each round computes the correlations again and counts those in the cells of a
    histogram; the cells that hold the wanted ranks are cut again until their values are few enough to be put in order.
    """
    label, told = _told(labels, time)
    kind = labels.schema[label].dataType
    spark = panel.sparkSession
    dealt = deal(panel, entity, time, x, by)
    dealt.series = cut(dealt.series, "dealt")

    def correlations(block: BlockPair) -> Iterator[tuple[int, int, np.ndarray]]:
        """For each label: its code, the number of pairs, and their correlations that aren't null."""
        at, code, _ = told.value
        for k in np.unique(code[np.isin(at, block.times)]):
            columns = np.isin(block.times, at[code == k])
            part = BlockPair(block.a, block.b, block.times[columns], block.x[:, columns], block.y[:, columns], block.wanted)
            tiles, rest = part.tiles()
            found = []
            for i, j, common in tiles:
                if len(common) >= max(least, 1):
                    c = _unit(part.x[np.ix_(i, common)]) @ _unit(part.y[np.ix_(j, common)]).T
                    wanted = block.wanted[np.ix_(i, j)]
                    found.append(c.ravel() if wanted.all() else c[wanted])
            i, j = np.flatnonzero(rest.any(1)), np.flatnonzero(rest.any(0))
            if len(i):
                m = _moments(part.x[i], part.y[j])
                found.append(_corr(m)[rest[np.ix_(i, j)] & (m["n"] >= max(least, 1))])
            c = np.concatenate(found) if found else np.zeros(0)
            yield k, len(c), c[~np.isnan(c)]

    def counted(cells: dict[int, list[tuple[int, int]]] | None) -> list:
        """(label, level, cell, part, n, sum) of the parts of the given cells; of the whole range at first, and then, as part -2, the pairs and the sum of their correlations."""
        sent = spark.sparkContext.broadcast(cells)

        def kernel(block: BlockPair) -> Iterator[Rows]:
            for k, n, c in correlations(block):
                u = (c + 1) / 2
                for level, cell in [(0, 0)] if sent.value is None else sent.value.get(int(k), []):
                    inside, size = u, 1 << CELL_BITS
                    if level:
                        inside = u[np.floor(u * 2.0 ** (CELL_BITS * level)) == cell]
                    part = np.clip(np.floor(inside * 2.0 ** (CELL_BITS * (level + 1))).astype(np.int64) - cell * size, 0 if level else -1, size - 1 if level else size) + 1
                    count = np.bincount(part, minlength=size + 2)
                    held = np.flatnonzero(count)
                    if not level:
                        yield {"_k": np.array([k]), "_level": np.array([level]), "_cell": np.array([0]), "_part": np.array([-2]), "_n": np.array([n]), "_s": np.array([c.sum()])}
                    one = np.ones(len(held), np.int64)
                    yield {"_k": k * one, "_level": level * one, "_cell": cell * one, "_part": held - 1, "_n": count[held], "_s": 0.0 * one}

        fields = [T.StructField(n, T.DoubleType() if n == "_s" else T.LongType()) for n in ("_k", "_level", "_cell", "_part", "_n", "_s")]
        return run_blocks(dealt, kernel, fields).groupBy("_k", "_level", "_cell", "_part").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s")).collect()  # at most 514 rows for each label and wanted rank

    ladder: dict[tuple[int, int, int], list] = {}
    for r in counted(None):
        ladder.setdefault((r["_k"], r["_level"], r["_cell"]), []).append(r)
    names = told.value[2].to_pylist()
    whole, goals = [], []  # goals: label, name's number, low or high rank, weight of the high one, level, cell, values before the cell and in it
    for (k, _, _), rows in ladder.items():
        head = next(r for r in rows if r["_part"] == -2)
        n = sum(r["_n"] for r in rows if r["_part"] > -2)
        whole.append((int(k), names[k], head["_n"], n, head["_s"] / n if n else None))
        for w, p in enumerate(wanted.values()):
            at = (n - 1) * p
            goals += [[int(k), w, side, at - np.floor(at), 0, 0, 0, n, int(rank)] for side, rank in enumerate((np.floor(at), np.ceil(at)))] if n else []
    done: list[list] = []
    while goals:
        for g in goals:
            before, size = g[6], 1 << CELL_BITS
            for r in sorted((r for r in ladder[g[0], g[4], g[5]] if r["_part"] > -2), key=lambda r: r["_part"]):
                if before + r["_n"] > g[8]:
                    g[4:8] = g[4] + 1, g[5] * size + r["_part"], before, r["_n"]
                    break
                before += r["_n"]
        edge = lambda g: not 0 <= g[5] < 1 << (CELL_BITS * g[4])  # noqa: E731 - a correlation of 1 and a bit
        done += [g for g in goals if g[7] <= CELL_VALUES or g[4] >= CELL_ROUNDS or edge(g)]
        goals = [g for g in goals if not (g[7] <= CELL_VALUES or g[4] >= CELL_ROUNDS or edge(g))]
        if goals:
            cells: dict[int, list[tuple[int, int]]] = {}
            for g in goals:
                if (g[4], g[5]) not in cells.setdefault(g[0], []):
                    cells[g[0]].append((g[4], g[5]))
            ladder = {}
            for r in counted(cells):
                ladder.setdefault((r["_k"], r["_level"], r["_cell"]), []).append(r)
    last: dict[int, list[tuple[int, int]]] = {}
    for g in done:
        if (g[4], g[5]) not in last.setdefault(g[0], []):
            last[g[0]].append((g[4], g[5]))
    sent = spark.sparkContext.broadcast(last)

    def values(block: BlockPair) -> Iterator[Rows]:
        for k, _, c in correlations(block):
            u = (c + 1) / 2
            for level, cell in sent.value.get(int(k), []):
                v, n = np.unique(c[np.clip(np.floor(u * 2.0 ** (CELL_BITS * level)), -1, 2 ** (CELL_BITS * level)) == cell], return_counts=True)
                one = np.ones(len(v), np.int64)
                yield {"_k": k * one, "_level": level * one, "_cell": cell * one, "_v": v, "_n": n}

    fields = [T.StructField(n, T.DoubleType() if n == "_v" else T.LongType()) for n in ("_k", "_level", "_cell", "_v", "_n")]
    keys = ["_k", "_level", "_cell"]
    held = run_blocks(dealt, values, fields).groupBy(*keys, "_v").agg(F.sum("_n").alias("_n"))
    upto = held.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v")))  # the values of one cell
    goal = spark.createDataFrame([(g[0], g[4], g[5], g[1], g[2], float(g[3]), int(g[8] - g[6])) for g in done], "_k long, _level long, _cell long, _w int, _side int, _weight double, _rank long")
    found = upto.join(F.broadcast(goal), keys).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank")))
    pick = lambda c, w, side: F.max(F.when((F.col("_w") == w) & (F.col("_side") == side), F.col(c)))
    mixed = {n: F.when(pick("_weight", w, 0) == 0, pick("_v", w, 0)).otherwise((1 - pick("_weight", w, 0)) * pick("_v", w, 0) + pick("_weight", w, 0) * pick("_v", w, 1)) for w, n in enumerate(wanted)}
    picked = found.groupBy("_k").agg(*[c.alias(n) for n, c in mixed.items()])
    base = spark.createDataFrame(whole, T.StructType([T.StructField("_k", T.LongType()), T.StructField(label, kind), T.StructField("n", T.LongType()), T.StructField("pairs", T.LongType()), T.StructField("mean", T.DoubleType())]))
    return base.where("n > 0").join(F.broadcast(picked), "_k", "left").drop("_k")  # a row for each label


def step_up_limits(dealt: Dealt, tests: Callable[[BlockPair], Iterator[tuple[int, np.ndarray]]], alpha: float) -> dict[int, float]:
    """The limit of ``pairs.step_up_limits`` for each family of p-values, which ``tests`` gives with their family for each block pair; NaN are no tests.

    P-values never leave their tasks: the blocks are computed once for the counts of their cells, where those above alpha,
    which never pass, are one cell, and once more for the values of the few cells that the counts leave open.
    """
    spark, size = dealt.series.sparkSession, pairs.STEP_UP_CELLS

    def placed(block: BlockPair) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        for family, p in tests(block):
            low = p[p <= alpha]
            yield family, low, np.floor(low * size).astype(np.int64), int(np.count_nonzero(p > alpha))

    def counts(block: BlockPair) -> Iterator[Rows]:
        total: dict[int, np.ndarray] = {}
        for family, _, cell, above in placed(block):
            held = total.setdefault(family, np.zeros(size + 2, np.int64))
            held += np.bincount(cell, minlength=size + 2)
            held[size + 1] += above
        for family, held in total.items():
            cell = np.flatnonzero(held)
            yield {"_family": np.full(len(cell), family), "_cell": cell, "_c": held[cell]}

    def opened(some: DataFrame) -> DataFrame:
        held: dict[int, list[int]] = {}
        for r in some.collect():  # at most a row for each cell of a family
            held.setdefault(r["_family"], []).append(r["_cell"])
        sent = spark.sparkContext.broadcast({family: np.array(cells) for family, cells in held.items()})

        def values(block: BlockPair) -> Iterator[Rows]:
            for family, low, cell, _ in placed(block):
                here = np.isin(cell, sent.value.get(family, np.zeros(0, np.int64)))
                if here.any():
                    p, n = np.unique(low[here], return_counts=True)
                    yield {"_family": np.full(len(p), family), "_cell": np.floor(p * size).astype(np.int64), "_p": p, "_c": n}

        if not held:
            return spark.createDataFrame([], "_family long, _cell long, _p double, _c long")
        fields = [T.StructField(n, T.DoubleType() if n == "_p" else T.LongType()) for n in ("_family", "_cell", "_p", "_c")]
        return run_blocks(dealt, values, fields).groupBy("_family", "_cell", "_p").agg(F.sum("_c").alias("_c"))

    fields = [T.StructField(n, T.LongType()) for n in ("_family", "_cell", "_c")]
    cells = run_blocks(dealt, counts, fields).groupBy("_family", "_cell").agg(F.sum("_c").alias("_c"))
    return {r["_family"]: r["limit"] for r in pairs.limits_of_cells(cells, opened, alpha, ["_family"]).collect()}  # a row for each family


def step_up_pairs(panel: DataFrame, entity: str, time: str, x: str, by: list[str], least: int, alpha: float, places: int, digits: dict[str, int] | None = None) -> DataFrame:
    """(by, a, b, p, survives): p-value of the correlation of each pair with at least so many common times, to so many decimals, and whether it passes the Benjamini-Hochberg step-up over all of them; pairs without a correlation are left out."""
    dealt = deal(panel, entity, time, x, by)
    dealt.series = cut(dealt.series, "dealt")

    def tests(block: BlockPair) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs with a correlation as a mask over some series of both sides, those series, and the p-values."""
        tiles, rest = block.tiles()
        for i, j, common in tiles:
            if len(common) >= max(least, 1):
                c = _unit(block.x[np.ix_(i, common)]) @ _unit(block.y[np.ix_(j, common)]).T
                here = block.wanted[np.ix_(i, j)] & ~np.isnan(c)
                yield i, j, here, round_half_up(corr_p_value(c[here], len(common)), places)
        i, j = np.flatnonzero(rest.any(1)), np.flatnonzero(rest.any(0))
        if len(i):
            m = _moments(block.x[i], block.y[j])
            c = _corr(m)
            here = rest[np.ix_(i, j)] & (m["n"] >= max(least, 1)) & ~np.isnan(c)
            yield i, j, here, round_half_up(corr_p_value(c[here], m["n"][here]), places)

    limit = step_up_limits(dealt, lambda block: ((0, p) for *_, p in tests(block)), alpha).get(0, 0.0)

    def kernel(block: BlockPair) -> Iterator[Rows]:
        for i, j, here, p in tests(block):
            r, c = np.nonzero(here)
            first, second, _ = block.names(i[r], j[c])
            yield {"a": first, "b": second, "p": p, "survives": p <= limit}

    return run_blocks(dealt, kernel, _pair_fields(panel, entity, p=T.DoubleType(), survives=T.BooleanType()), digits)


def _window_corr(x: np.ndarray, y: np.ndarray, valid: np.ndarray, rows: int) -> np.ndarray:
    """Correlation of each row's last ``rows`` values up to each place from place rows - 1 on; NaN where there are fewer or one side is constant."""
    if x.shape[1] < rows:
        return np.zeros((len(x), 0))
    count = np.maximum(valid.sum(1), 1)[:, None]
    x, y = (np.where(valid, v - v.sum(1, keepdims=True) / count, 0.0) for v in (x, y))

    def sums(v: np.ndarray) -> np.ndarray:
        s = np.concatenate([np.zeros((len(v), 1)), np.cumsum(v, 1)], 1)
        return s[:, rows:] - s[:, :-rows]

    sx, sy, sxx, syy, sxy = sums(x), sums(y), sums(x * x), sums(y * y), sums(x * y)
    with np.errstate(invalid="ignore", divide="ignore"):
        vx, vy = sxx - sx * sx / rows, syy - sy * sy / rows
        flat = (vx <= FLAT * (x * x).sum(1, keepdims=True)) | (vy <= FLAT * (y * y).sum(1, keepdims=True))
        return np.where(flat | ~valid[:, rows - 1 :], np.nan, (sxy - sx * sy / rows) / np.sqrt(vx * vy))


def _series_sums(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By window: the number of unit rows, their sum, their second moment, and the sums of their squared lengths and of the squares of these."""
    there = ~np.isnan(v[:, :, 0])
    v = np.where(there[:, :, None], v, 0.0)
    own = (v * v).sum(2)
    return there.sum(1), v.sum(1), v.transpose(0, 2, 1) @ v, np.stack([own.sum(1), (own * own).sum(1)], 1)


def _pair_sums(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...] | None) -> np.ndarray:
    """Number, sum and sum of squares of the products of all pairs of unit rows by window, from the sums over both sides' series; without a second side of the pairs of the first.

    The sum of all products is that of the summed rows, and the sum of their squares that of the elements of both second
    moments: the work grows with the series, not with their pairs.
    """
    n, s, q, own = one
    if two is None:
        return np.stack([n * (n - 1) / 2, ((s * s).sum(1) - own[:, 0]) / 2, ((q * q).sum((1, 2)) - own[:, 1]) / 2])
    m, t, p, _ = two
    return np.stack([n * m, (s * t).sum(1), (q * p).sum((1, 2))])


def _shared_parts(series: DataFrame, fields: list[T.StructField], time: T.StructField, rows: list[int], parts: list[T.StructField]) -> DataFrame:
    """The sums by time (parts) over all pairs of series with shared times (``_class``, of ``_n`` series in the group).

    Each series meets the classes of its group: sums over the series of a class, over the times that it has in common
    with the other one, are added up for each two classes and give the sums over their pairs. So the work is that of
    the series times the classes, and no block is paired.
    """
    by = [f.name for f in fields]
    classes = series.groupBy(*by, "_class").agg(F.first("_n").alias("_n"), F.first(F.array_sort("_series.t")).alias("_times"))
    left, right = (classes.select(*[F.col(c).alias(f"{side}_{c}") for c in classes.columns]) for side in ("l", "r"))
    two = left.join(right, [F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in by] + [F.col("l__class") <= F.col("r__class")])
    side = F.explode(F.when(F.col("l__class") == F.col("r__class"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    two = two.select(*[F.col(f"l_{c}").alias(c) for c in by], F.col("l__class").alias("_p"), F.col("r__class").alias("_q"), F.array_intersect("l__times", "r__times").alias("_times"), F.col("l__n"), F.col("r__n"), side.alias("_side")).where(F.size("_times") > 0)
    chunks = F.greatest(F.ceil(F.col("_n") / SHARED_CHUNK), F.ceil(F.col("_n") * F.size("_times") / BLOCK_VALUES)).cast("int")
    first = F.col("_side") == 0
    two = cut(two.withColumn("_n", F.when(first, F.col("l__n")).otherwise(F.col("r__n"))).withColumn("_class", F.when(first, F.col("_p")).otherwise(F.col("_q"))).withColumn("_chunks", chunks).drop("l__n", "r__n", "_n"), "classes")
    total = two.agg(F.sum("_chunks")).first()[0] or 1
    each = series.drop("_n").withColumnsRenamed({c: f"_s_{c}" for c in (*by, "_class")})
    met = each.join(two, [F.col(f"_s_{c}").eqNullSafe(F.col(c)) for c in by] + [F.col("_s__class") == F.col("_class")]).withColumn("_chunk", F.pmod(F.xxhash64("_entity"), F.col("_chunks")))
    met = met.select(*by, "_p", "_q", "_side", "_chunk", "_times", "_series")

    numbers = T.ArrayType(T.DoubleType())
    summed = T.StructType([*fields, T.StructField("_p", T.StringType()), T.StructField("_q", T.StringType()), T.StructField("rows", T.IntegerType()), T.StructField("_slice", T.IntegerType()), T.StructField("_side", T.IntegerType()), T.StructField("_at", T.IntegerType()), time, T.StructField("_n", T.LongType()), T.StructField("_s", numbers), T.StructField("_q2", numbers), T.StructField("_o", numbers)])
    summed_types = pa.schema([(f.name, _arrow(f.dataType)) for f in summed.fields])
    made = T.StructType([*fields, *parts])
    made_types = pa.schema([(f.name, _arrow(f.dataType)) for f in made.fields])

    def places(r: int) -> int:
        """Places of one slice: its second moments are of bounded size."""
        return max(1, TILE_VALUES // (r * r))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in map(lambda b: pa.Table.from_batches([b]), batches):
            if not len(t):
                continue
            given = t["_series"].combine_chunks()
            flat = given.flatten()
            of, at, v = pc.list_parent_indices(given).to_numpy(), flat.field("t").to_numpy(zero_copy_only=False), flat.field("x").to_numpy(zero_copy_only=False)
            names = pc.list_flatten(t["_times"].slice(0, 1)).combine_chunks()
            times = names.to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(times, at), len(times) - 1)
            own = times[place] == at
            x = np.full((len(t), len(times)), np.nan)
            x[of[own], place[own]] = v[own]
            for r in rows:
                for lo in range(0, len(times), places(r)):
                    hi = min(lo + places(r), len(times))
                    begin, size = max(lo - r + 1, 0), max(hi - max(lo, r - 1), 0)
                    found = None
                    if size:
                        for k in range(0, len(x), max(1, TILE_VALUES // (size * r))):
                            now = _series_sums(_window_units(x[k : k + max(1, TILE_VALUES // (size * r))], r, slice(begin, begin + size)))
                            found = now if found is None else tuple(a + b for a, b in zip(found, now, strict=True))
                    empty, n = hi - lo - size, hi - lo
                    lists = lambda k, width: pa.ListArray.from_arrays(np.concatenate([np.zeros(empty), np.arange(size + 1) * width]).astype(np.int32), found[k].ravel() if size else np.zeros(0))  # noqa: B023, E731
                    out = {c: pa.repeat(t[c][0], n) for c in (*by, "_p", "_q", "_side")}
                    out |= {"rows": np.full(n, r), "_slice": np.full(n, lo), "_at": np.arange(lo, hi), time.name: names.slice(lo, n), "_n": np.concatenate([np.zeros(empty), found[0] if size else []]).astype(np.int64), "_s": lists(1, r), "_q2": lists(2, r * r), "_o": lists(3, 2)}
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name]).cast(f.type) for f in summed_types], schema=summed_types)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = two = None
        for t in map(lambda b: pa.Table.from_batches([b]), batches):
            if not len(t):
                continue
            if one is None:
                first, r, lo = t.slice(0, 1), t["rows"][0].as_py(), t["_slice"][0].as_py()
                m = places(r)
                one, two = ((np.zeros(m), np.zeros((m, r)), np.zeros((m, r * r)), np.zeros((m, 2))) for _ in range(2))
                seen, names = np.zeros(m, bool), {}
            side, at = t["_side"].to_numpy(), t["_at"].to_numpy() - lo
            for k in np.flatnonzero(~seen[at]):
                names.setdefault(at[k], t[time.name][int(k)].as_py())
            seen[at] = True
            there = at + lo >= r - 1
            for which, held in ((0, one), (1, two)):
                mine = there & (side == which)
                rows_of = t.filter(pa.array(mine))
                np.add.at(held[0], at[mine], rows_of["_n"].to_numpy())
                for c, k in (("_s", 1), ("_q2", 2), ("_o", 3)):
                    np.add.at(held[k], at[mine], pc.list_flatten(rows_of[c]).to_numpy().reshape(-1, held[k].shape[1]))
        where = np.flatnonzero(seen)
        one, two = (tuple(v[where] if k != 2 else v[where].reshape(-1, r, r) for k, v in enumerate(h)) for h in (one, two))
        n, s, q = _pair_sums(one, None if first["_p"][0] == first["_q"][0] else two)
        out = {c: pa.repeat(first[c][0], len(where)) for c in by}
        out |= {"rows": np.full(len(where), r), time.name: pa.array([names[k] for k in where], made_types.field(time.name).type), "_n": n.astype(np.int64), "_s": s, "_q": q}
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name]).cast(f.type) for f in made_types], schema=made_types)

    key = [*by, "_p", "_q"]
    told = met.repartition(int(min(total, BLOCK_TASKS)), *key, "_side", "_chunk").groupBy(*key, "_side", "_chunk").applyInArrow(sums, summed)
    return told.groupBy(*key, "rows", "_slice").applyInArrow(pairs, made)


def rolling_by_time(panel: DataFrame, entity: str, time: str, x: str, by: list[str], rows: list[int]) -> DataFrame:
    """(by, rows, time, n, mean_corr, std_corr) for each time that a pair has in common: how many pairs have a correlation over their last common rows by then (0: none, and null values), its mean and its sample deviation over them.

    A pair of blocks gives one row for each time; Spark adds them up. Pairs of series whose times at least SHARED_SERIES
    series of their group have are never formed (see ``_shared_parts``).
    """
    fields = [T.StructField("rows", T.IntegerType()), panel.schema[time], T.StructField("_n", T.LongType()), T.StructField("_s", T.DoubleType()), T.StructField("_q", T.DoubleType())]

    def kernel(block: BlockPair) -> dict[str, np.ndarray]:
        sums, common = np.zeros((len(rows), 3, len(block.times))), np.zeros(len(block.times), bool)
        tiles, rest = block.tiles()
        for i, j, columns in tiles:
            inside = block.wanted[np.ix_(i, j)]
            alike = block.x is block.y  # a block with itself: each two classes once
            if not len(columns) or (alike and (i[0] > j[0] or len(i) < 2 and i[0] == j[0])) or not (alike or inside.any()):
                continue
            common[columns] = True
            for k, r in enumerate(rows):
                if len(columns) >= r:
                    one = _series_sums(_window_units(block.x[np.ix_(i, columns)], r))
                    sums[k][:, columns[r - 1 :]] += _pair_sums(one, None if alike and i[0] == j[0] else _series_sums(_window_units(block.y[np.ix_(j, columns)], r)))
        for _, _, vx, vy, valid, at in block.rows(rest):
            common[at[valid]] = True
            for k, r in enumerate(rows):
                c = _window_corr(vx, vy, valid, r)
                ok = ~np.isnan(c)
                where, c = at[:, r - 1 :][ok], c[ok]
                for d, v in enumerate((np.ones(len(c)), c, c * c)):
                    sums[k, d] += np.bincount(where, v, minlength=len(block.times))
        k, t = np.nonzero(np.repeat(common[None], len(rows), 0))
        return {"rows": np.array(rows)[k], time: block.times[t], "_n": sums[k, 0, t].astype(np.int64), "_s": sums[k, 1, t], "_q": sums[k, 2, t]}

    series = _pack(panel, entity, time, x, by).withColumn("_class", F.md5(F.concat_ws(",", F.transform(F.array_sort("_series.t"), lambda t: t.cast("string"))).cast("binary")))
    series = meet(series, series.groupBy(*by, "_class").agg(F.count(F.lit(1)).alias("_n")), [*by, "_class"]).withColumn("_shared", F.col("_n") >= SHARED_SERIES)
    groups = [panel.schema[c] for c in by]
    shared = _shared_parts(series.where("_shared").drop("_shared"), groups, panel.schema[time], rows, fields)
    parts = run_blocks(_dealt(series, groups), kernel, fields).unionByName(shared).groupBy(*by, "rows", time)
    n, s, q = F.sum("_n"), F.sum("_s"), F.sum("_q")
    return parts.agg(n.alias("n"), div(s, n).alias("mean_corr"), F.when(n > 1, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1))).alias("std_corr"))


def rolling_by_pair(panel: DataFrame, entity: str, time: str, x: str, by: list[str], rows: int, digits: dict[str, int] | None = None) -> DataFrame:
    """(by, a, b, n, mean, std, span, iqr, positive) of each pair's correlations over its last common rows, over all times that have one."""
    doubles = dict.fromkeys(("mean", "std", "span", "iqr", "positive"), T.DoubleType())
    fields = _pair_fields(panel, entity, n=T.LongType(), **doubles)

    def kernel(block: BlockPair) -> Iterator[Rows]:
        tiles, rest = block.tiles()
        for i, j, columns in tiles:
            if len(columns) < rows:
                continue
            wanted = block.wanted[np.ix_(i, j)]
            if not wanted.any():
                continue
            ux, uy = _window_units(block.x[np.ix_(i, columns)], rows), _window_units(block.y[np.ix_(j, columns)], rows).transpose(0, 2, 1)
            step = max(1, PART_VALUES // (len(ux) * len(j)))
            for k in range(0, len(i), step):
                here = wanted[k : k + step]
                if not here.any():
                    continue
                r, c, first, second, _ = block.cells(i[k : k + step], j)
                all_windows = (ux[:, k : k + step] @ uy).transpose(1, 2, 0)
                yield told(first, second, all_windows.reshape(-1, len(ux)) if here.all() else all_windows[r, c])
        for i, j, vx, vy, valid, _ in block.rows(rest):
            c = _window_corr(vx, vy, valid, rows)
            if c.shape[1]:
                first, second, _ = block.names(np.full(len(j), i), j)
                yield told(first, second, c)

    def told(first: np.ndarray, second: np.ndarray, c: np.ndarray) -> Rows:
        """The row of each pair that has a correlation, from its correlations; missing ones are put last."""
        c = np.sort(c, 1)
        n = (~np.isnan(c)).sum(1) if np.isnan(c[:, -1]).any() else np.full(len(c), c.shape[1])
        if not n.all():
            first, second, c, n = first[n > 0], second[n > 0], c[n > 0], n[n > 0]
        at = np.arange(len(c))
        full = (n == c.shape[1]).all()
        mean = (c.sum(1) if full else np.nansum(c, 1)) / n
        gap = c - mean[:, None]
        square = np.einsum("ij,ij->i", gap, gap) if full else np.nansum(gap * gap, 1)
        positive = (c > 0).sum(1) / n

        def quantile(p: float) -> np.ndarray:
            place = (n - 1) * p
            low = np.floor(place).astype(np.int64)
            return c[at, low] + (place - low) * (c[at, np.minimum(low + 1, n - 1)] - c[at, low])

        with np.errstate(invalid="ignore", divide="ignore"):
            std = np.where(n > 1, np.sqrt(square / (n - 1)), np.nan)
        return {"a": first, "b": second, "n": n, "mean": mean, "std": std, "span": c[at, n - 1] - c[:, 0], "iqr": quantile(0.75) - quantile(0.25), "positive": positive}

    return over_blocks(panel, entity, time, x, by, kernel, fields, digits)


def ewma_cov(panel: DataFrame, entity: str, time: str, x: str, by: list[str], lam: float = 0.94) -> DataFrame:
    """(by, a, b, ewma) over each pair's common times: a product's weight is (1 - lam) * lam ** (products after it), and the first one, which seeds the recursion, has lam ** (products after it)."""
    fields = _pair_fields(panel, entity, ewma=T.DoubleType())

    def kernel(block: BlockPair) -> dict[str, np.ndarray]:
        parts = []
        for i, j, vx, vy, valid, _ in block.rows():
            n = valid.sum(1)
            after = n[:, None] - 1 - np.arange(valid.shape[1])
            weight = np.where(valid, lam ** np.maximum(after, 0) * (1 - lam), 0.0)
            if valid.shape[1]:
                weight[:, 0] /= 1 - lam
            first, second, _ = block.names(np.full(len(j), i), j)
            parts.append(tuple(v[n > 0] for v in (first, second, (weight * vx * vy).sum(1))))
        return dict(zip(("a", "b", "ewma"), map(np.concatenate, zip(*parts, strict=True)), strict=True)) if parts else {}

    return over_blocks(panel, entity, time, x, by, kernel, fields)


def tail_dependence(panel: DataFrame, entity: str, time: str, x: str, by: list[str], q: float = 0.05, least: int = 20) -> DataFrame:
    """(by, a, b, upper, lower): joint exceedance rate over q of both tails; thresholds by pair, over its common times, of which there are ``least`` at least."""
    fields = _pair_fields(panel, entity, upper=T.DoubleType(), lower=T.DoubleType())

    def kernel(block: BlockPair) -> dict[str, np.ndarray]:
        parts = []
        tiles, rest = block.tiles()
        for i, j, columns in tiles:
            if len(columns) >= max(least, 1):
                sides = [v[np.ix_(k, columns)] for v, k in ((block.x, i), (block.y, j))]
                ends = [np.quantile(v, [q, 1 - q], axis=1)[:, :, None] for v in sides]
                upper, lower = ((f(sides[0], ends[0][e]).astype(np.float32) @ f(sides[1], ends[1][e]).astype(np.float32).T).astype(float) / len(columns) / q for f, e in ((np.greater, 1), (np.less, 0)))
                r, c, first, second, _ = block.cells(i, j)
                parts.append((first, second, upper[r, c], lower[r, c]))
        for i, j, vx, vy, valid, _ in block.rows(rest):
            n = valid.sum(1)
            keep = n >= max(least, 1)
            if not keep.any():
                continue
            j, n, ok = j[keep], n[keep], valid[keep]
            sides = [np.where(ok, v[keep], np.nan) for v in (vx, vy)]
            low, high = zip(*(np.nanquantile(v, [q, 1 - q], axis=1)[:, :, None] for v in sides), strict=True)
            with np.errstate(invalid="ignore"):
                upper = ((sides[0] > high[0]) & (sides[1] > high[1])).sum(1) / n / q
                lower = ((sides[0] < low[0]) & (sides[1] < low[1])).sum(1) / n / q
            first, second, _ = block.names(np.full(len(j), i), j)
            parts.append((first, second, upper, lower))
        return dict(zip(("a", "b", "upper", "lower"), map(np.concatenate, zip(*parts, strict=True)), strict=True)) if parts else {}

    return over_blocks(panel, entity, time, x, by, kernel, fields)


def reversion(panel: DataFrame, entity: str, time: str, x: str, by: list[str], digits: dict[str, int] | None = None) -> DataFrame:
    """(by, a, b, beta, rho, t, half_life, p_value): hedge ratio of b on a, then the first-order regression of the spread b - beta a over the pair's common times.

    t is the unit-root statistic (1 - rho) / its standard error, large where the spread reverts, p_value that of -t for two
    series; half_life is -ln 2 / ln rho, null where rho isn't inside (0, 1). All of it is made inside the blocks, the
    rounding to digits too: by expressions on rows it takes longer than the regressions themselves.
    """
    doubles = dict.fromkeys(("beta", "rho", "t", "half_life", "p_value"), T.DoubleType())
    fields = _pair_fields(panel, entity, **doubles)

    def told(first: np.ndarray, second: np.ndarray, beta: np.ndarray, rho: np.ndarray, t: np.ndarray, ok: np.ndarray) -> Rows:
        first, second, beta, rho, t = (v[ok] for v in (first, second, beta, rho, t))
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            life = np.where((rho > 0) & (rho < 1), -np.log(2.0) / np.log(rho), np.nan)
            return {"a": first, "b": second, "beta": beta, "rho": rho, "t": t, "half_life": life, "p_value": unit_root_p(-t)}

    def fit(one: np.ndarray, two: np.ndarray, valid: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rho and t of pairs of series by their spreads."""
        k = np.maximum(valid.sum(1) - 1, 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            s = two - np.where(np.isnan(beta), 0.0, beta)[:, None] * one
            pair = valid[:, 1:]
            before, now = (np.where(pair, v, 0.0) for v in (s[:, :-1], s[:, 1:]))
            mb, mn = before.sum(1) / k, now.sum(1) / k
            db, dn = np.where(pair, before - mb[:, None], 0.0), np.where(pair, now - mn[:, None], 0.0)
            vb, vn, c = (db * db).sum(1) / (k - 1), (dn * dn).sum(1) / (k - 1), (db * dn).sum(1) / (k - 1)
            return solve(k, vb, vn, c, (before * before).sum(1) / np.maximum(k, 1))

    def solve(k: np.ndarray | int, vb: np.ndarray, vn: np.ndarray, c: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(invalid="ignore", divide="ignore"):
            rho = np.where(vb > FLAT * square, c / vb, np.nan)
            error = np.sqrt((vn - rho * rho * vb) / (vb * (k - 2)))
            return rho, np.where((k > 2) & (error > 0), (1 - rho) / error, np.nan)

    def tile(block: BlockPair, i: np.ndarray, j: np.ndarray, columns: np.ndarray, cov: np.ndarray, vx: np.ndarray, vy: np.ndarray) -> Rows:
        """The moments of a spread are sums of those of both series, so no spread is formed unless they cancel out."""
        r, c, first, second, turned = block.cells(i, j)
        x, y = block.x[np.ix_(i, columns)], block.y[np.ix_(j, columns)]
        k = len(columns) - 1
        with np.errstate(invalid="ignore", divide="ignore"):
            var = np.where(turned, vy[r, c], vx[r, c])
            beta = np.where(var > 0, cov[r, c] / var, np.nan)
            mx, my = x[:, :-1].mean(1), y[:, :-1].mean(1)
            (xb, xn), (yb, yn) = ([v[:, e] - v[:, e].mean(1, keepdims=True) for e in (slice(None, -1), slice(1, None))] for v in (x, y))
            bb, nn, bn = xb @ yb.T, xn @ yn.T, xb @ yn.T + xn @ yb.T
            own = [np.array([(p * q).sum(1) for p, q in ((a, a), (b, b), (a, b))]) for a, b in ((xb, xn), (yb, yn))]
            one, two = np.where(turned, own[1][:, c], own[0][:, r]), np.where(turned, own[0][:, r], own[1][:, c])
            vb, vn, both = ((t - beta * f * v[r, c] + beta * beta * o) / (k - 1) for t, o, v, f in ((two[0], one[0], bb, 2), (two[1], one[1], nn, 2), (two[2], one[2], bn, 1)))
            mean = np.where(turned, mx[r] - beta * my[c], my[c] - beta * mx[r])
            rho, t = solve(k, vb, vn, both, vb * (k - 1) / max(k, 1) + mean * mean)
            close = np.flatnonzero(~(np.minimum(vb, vn) * (k - 1) > 1e-6 * np.maximum(two[0] + two[1], beta * beta * (one[0] + one[1]))))
        for e in np.array_split(close, max(1, len(close) * len(columns) // TILE_VALUES)):
            px, py = x[r[e]], y[c[e]]
            flip = turned[e][:, None]
            rho[e], t[e] = fit(np.where(flip, py, px), np.where(flip, px, py), np.ones(px.shape, bool), beta[e])
        return told(first, second, beta, rho, t, ~np.isnan(beta))

    def kernel(block: BlockPair) -> Iterator[Rows]:
        m = _moments(block.x, block.y)
        tiles, rest = block.tiles()
        for i, j, columns in tiles:
            if len(columns) > 1:
                yield tile(block, i, j, columns, *(m[v][np.ix_(i, j)] for v in ("cov", "vx", "vy")))
        for i, j, vx, vy, valid, _ in block.rows(rest):
            first, second, turned = block.names(np.full(len(j), i), j)
            var = np.where(turned, m["vy"][i, j], m["vx"][i, j])
            with np.errstate(invalid="ignore", divide="ignore"):
                beta = np.where(var > 0, m["cov"][i, j] / var, np.nan)
            rho, t = fit(np.where(turned[:, None], vy, vx), np.where(turned[:, None], vx, vy), valid, beta)
            yield told(first, second, beta, rho, t, ~np.isnan(beta) & (valid.sum(1) >= 2))

    return over_blocks(panel, entity, time, x, by, kernel, fields, digits)


#: Rows of the deviations, first row with a value, limits of a product and of the filtered correlation.
CORR_ROWS, CORR_FIRST, PRODUCT_LIMIT = 20, 5, 3.0


def _trailing_deviation(v: np.ndarray, rows: int) -> np.ndarray:
    """Population deviation of each row's last ``rows`` values up to each place, or of as many as there are."""
    most = v.shape[1]
    n = np.minimum(np.arange(most) + 1, rows)
    mean, square = np.zeros(v.shape), np.zeros(v.shape)
    for k in range(min(rows, most)):
        mean[:, k:] += v[:, : most - k]
    mean /= n
    for k in range(min(rows, most)):
        gap = v[:, : most - k] - mean[:, k:]
        square[:, k:] += gap * gap
    return np.sqrt(square / n)


def filtered_correlation(panel: DataFrame, entity: str, time: str, x: str, by: list[str], q: float = 1e-4, r: float = 0.05, digits: dict[str, int] | None = None) -> DataFrame:
    """(by, a, b, time, corr) for each pair and each time that it has in common: the product of its values over both deviations of the last 20 common rows, held inside -3 and 3, as the seen value of a filtered level, itself held inside -1 and 1; null in the first five rows.

    Series that share their times are scaled once for all of their partners.
    """
    fields = [*_pair_fields(panel, entity), panel.schema[time], T.StructField("corr", T.DoubleType())]

    def scaled(v: np.ndarray) -> np.ndarray:
        return v / (_trailing_deviation(v, CORR_ROWS) + 1e-12)

    def filtered(seen: np.ndarray) -> np.ndarray:
        """The level of each pair (column) after each of its values (rows), which it overwrites."""
        np.clip(seen, -PRODUCT_LIMIT, PRODUCT_LIMIT, out=seen)
        seen[:CORR_FIRST] = np.nan
        m, p = np.zeros(seen.shape[1]), 1.0
        for t in range(CORR_FIRST, len(seen)):  # the variance is that of all pairs: they differ in where they end
            p += q
            gain = p / (p + r)
            m += gain * (seen[t] - m)
            p *= 1 - gain
            seen[t] = m
        return np.clip(seen, -1, 1, out=seen)

    def kernel(block: BlockPair) -> Iterator[Rows]:
        tiles, rest = block.tiles()
        for i, j, columns in tiles:
            n = len(columns)
            if not n:
                continue
            ux, uy = scaled(block.x[np.ix_(i, columns)]).T.copy(), scaled(block.y[np.ix_(j, columns)]).T.copy()
            one, two, first, second, _ = block.cells(i, j)
            for k in range(0, len(one), max(1, PART_VALUES // n)):
                part = slice(k, k + max(1, PART_VALUES // n))
                out = filtered(ux[:, one[part]] * uy[:, two[part]])
                yield {"a": np.repeat(first[part], n), "b": np.repeat(second[part], n), time: np.tile(block.times[columns], out.shape[1]), "corr": out.T.ravel()}
        for i, j, vx, vy, valid, at in block.rows(rest):
            if valid.shape[1]:
                out = filtered((scaled(vx) * scaled(vy)).T.copy()).T
                first, second, _ = block.names(np.full(len(j), i), j)
                n = valid.sum(1)
                yield {"a": np.repeat(first, n), "b": np.repeat(second, n), time: block.times[at[valid]], "corr": out[valid]}

    return over_blocks(panel, entity, time, x, by, kernel, fields, digits)


#: What of a series its partner's lags leave, as a share of its square: none is left up to the first, and up to the second the sums are too rough.
SPANNED, ROUGH = 1e-14, 1e-7


def lead_lag(panel: DataFrame, entity: str, time: str, x: str, by: list[str], lag: int = 2, digits: dict[str, int] | None = None) -> DataFrame:
    """(by, a, b, n, f): F statistic of a's lags in a regression of b's values on their own lags over the pair's common times, null with too few; n is how many times have all lags.

    For series that share their times the first regression is made once for each series. What a partner's lags add to it
    follows from their products with its residual and with the orthonormal own lags, which are matrix products.
    """
    fields = _pair_fields(panel, entity, f=T.DoubleType(), n=T.IntegerType())

    def fitted(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each series: its lags (lag, series, time), these orthonormal, the residual of its values, the share of its square that this is, and whether its lags are sound."""
        rows = v.shape[1] - lag
        d = np.stack([v[:, lag - k : lag - k + rows] for k in range(lag + 1)])
        d = d - d.mean(2, keepdims=True)
        lags, own, e = d[1:], [], d[0]
        sound = np.ones(len(v), bool)
        with np.errstate(invalid="ignore", divide="ignore"):
            for k in range(lag):
                left = lags[k]
                for _ in range(2):  # twice, so that the directions are at right angles to the last digit
                    for o in own:
                        left = left - (left * o).sum(1, keepdims=True) * o
                size = (left * left).sum(1, keepdims=True)
                sound &= size[:, 0] > ROUGH * (lags[k] * lags[k]).sum(1)
                own.append(left / np.sqrt(size))
            for _ in range(2):
                for o in own:
                    e = e - (e * o).sum(1, keepdims=True) * o
            share = (e * e).sum(1) / (d[0] * d[0]).sum(1)
        return lags, np.stack(own), e, share, sound & (share > ROUGH)

    def tile(block: BlockPair, i: np.ndarray, j: np.ndarray, columns: np.ndarray) -> Iterator[Rows]:
        x, y = block.x[np.ix_(i, columns)], block.y[np.ix_(j, columns)]
        one, two, first, second, turned = block.cells(i, j)
        n = len(columns) - lag
        f = np.full(len(one), np.nan)
        if n > 2 * lag + 2 and len(one):
            sides = [fitted(v) for v in (x, y)]
            with np.errstate(invalid="ignore", divide="ignore"):
                for (lags, _, _, _, _), (_, own, e, share, sound), which, p, q in ((sides[0], sides[1], ~turned, one, two), (sides[1], sides[0], turned, two, one)):
                    at = np.flatnonzero(which)
                    if not len(at):
                        continue
                    p, q = p[at], q[at]
                    cross = [[l @ o.T for o in own] for l in lags]
                    gain, ok, none = added([[c[p, q] for c in row] for row in cross], [(l @ e.T)[p, q] for l in lags], lags, p)
                    rest = (e * e).sum(1)
                    sse = rest[q] - gain
                    f[at] = np.where(none, 0.0, gain / lag / (sse / (n - 2 * lag - 1)))
                    rough = at[~(sound[q] & (none | (ok & (sse > ROUGH * rest[q]))))]
                    for part in np.array_split(rough, len(rough) * len(columns) // TILE_VALUES + 1):
                        u, w = (x[one[part]], y[two[part]]) if which is not turned else (y[two[part]], x[one[part]])
                        f[part] = lead_lag_f(Layout(np.full(len(part), len(columns))), u.ravel(), w.ravel(), lag) if len(part) else f[part]
        yield {"a": first, "b": second, "f": f, "n": np.full(len(one), n)}

    def added(along: list[list[np.ndarray]], with_e: list[np.ndarray], lags: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By how much the lags lower the sum of squares, step by step of a Cholesky factorisation of what the own lags leave of them; whether its digits suffice, and whether nothing is left of any of them."""
        size = [(l * l).sum(1)[p] for l in lags]
        left = [[(lags[a] * lags[b]).sum(1)[p] - sum(s * t for s, t in zip(along[a], along[b], strict=True)) for b in range(a + 1)] for a in range(lag)]
        gain, ok, none = 0.0, True, True
        for a in range(lag):
            none = none & (left[a][a] <= SPANNED * size[a])
        g = list(with_e)
        for a in range(lag):
            pivot = left[a][a]
            ok = ok & (pivot > ROUGH * size[a])
            gain = gain + g[a] * g[a] / pivot
            for b in range(a + 1, lag):
                share = left[b][a] / pivot
                g[b] = g[b] - share * g[a]
                for c in range(a + 1, b + 1):
                    left[b][c] = left[b][c] - share * left[c][a]
        return gain, ok, none

    def kernel(block: BlockPair) -> Iterator[Rows]:
        tiles, rest = block.tiles()
        for i, j, columns in tiles:
            if len(columns):
                yield from tile(block, i, j, columns)
        for i, j, vx, vy, valid, _ in block.rows(rest):
            some = valid.any(1)
            if some.any():
                j, vx, vy, valid = j[some], vx[some], vy[some], valid[some]
                first, second, turned = block.names(np.full(len(j), i), j)
                n = valid.sum(1)
                one, two = np.where(turned[:, None], vy, vx), np.where(turned[:, None], vx, vy)
                yield {"a": first, "b": second, "f": lead_lag_f(Layout(n), one[valid], two[valid], lag), "n": n - lag}

    return over_blocks(panel, entity, time, x, by, kernel, fields, digits)
