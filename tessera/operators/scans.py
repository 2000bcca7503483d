"""Recursions over very long series as scans: a series is cut into blocks of rows, every block is one map from the state before it to the state after it, and the maps of a series are applied in order.

An exponential average is an affine map, a filter's variance a Möbius map, its level an affine map once the gains are
known. So a block is summed up without its neighbours, a few numbers per block pass from one to the next, and then each
block is filled by itself: a series of any length spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.grouped import Series, per_series
from tessera.operators.keys import meet
from tessera.scratch import cut, ordered_prefix

#: Rows of a series above which it is cut into blocks, and rows of a block.
LONG_SERIES = 1_000_000
BLOCK = 50_000


def is_long(df: DataFrame, keys: list[str]) -> bool:
    """Whether any series has more rows than one task should step through."""
    return (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > LONG_SERIES


def blocked(df: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """keys, time, columns with _rn, a row's place in its series from 0 on, and its _block; places come from range partitions and prefix sums."""
    placed = ordered_prefix(df.select(*keys, time, *columns), [*keys, time], [], "series")
    first = placed.groupBy(*keys).agg(F.min("pos").alias("_first"))
    return meet(placed, first, keys).withColumn("_rn", F.col("pos") - F.col("_first")).withColumn("_block", F.floor(F.col("_rn") / BLOCK)).drop("pos", "_first")


def with_halo(rows: DataFrame, before: int) -> DataFrame:
    """rows with the last ``before`` rows of each block in the next one too, where _own is false: windows of up to so many rows back then stay inside a block."""
    last = F.col("_rn") % BLOCK >= BLOCK - before
    each = F.array_compact(F.array(F.struct(F.col("_block").alias("b"), F.lit(True).alias("own")), F.when(last, F.struct((F.col("_block") + 1).alias("b"), F.lit(False).alias("own")))))
    return rows.withColumn("_x", F.explode(each)).withColumn("_block", F.col("_x.b")).withColumn("_own", F.col("_x.own")).drop("_x")


def _names(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(n)]


def _through(ends: DataFrame, keys: list[str], state: list[str], step: Callable[[Series, np.ndarray, np.ndarray], np.ndarray], first: list[float], columns: list[str]) -> DataFrame:
    """(keys, _block, state): the state before each block; ``step`` gives the states after the blocks of one step. A series has one row per block here."""

    def solve(s: Series) -> dict[str, np.ndarray]:
        out = np.empty((len(state), s.table.num_rows))
        now = np.repeat(np.array(first)[:, None], len(s.ranked), 1)
        for rows in s.steps():
            now = now[:, : len(rows)]
            out[:, rows] = now
            now = step(s, rows, now)
        return dict(zip(state, out, strict=True))

    return per_series(ends, keys, "_block", columns, ", ".join(f"{c} double" for c in state), solve)


def emas(rows: DataFrame, keys: list[str], specs: dict[str, tuple[str, float, int]]) -> DataFrame:
    """rows (from ``blocked``) with exponential averages, name -> (column, alpha, start): the column's value at row ``start`` of the series, then y + alpha (x - y); null before."""
    rows = cut(rows, "blocks")
    group = [*keys, "_block"]
    names = list(specs)

    def local(s: Series, start: dict[str, np.ndarray] | None) -> dict[str, np.ndarray]:
        at = s.table["_rn"].to_numpy()
        out = {}
        for name, (column, alpha, begin) in specs.items():
            x, y = s.values(column), np.full(len(s.row), np.nan)
            state = np.zeros(len(s.ranked)) if start is None else start[name][s.ranked]
            for r in s.steps():
                state = np.where(at[r] == begin, x[r], np.where(at[r] > begin, state[: len(r)] + alpha * (x[r] - state[: len(r)]), state[: len(r)]))
                y[r] = np.where(at[r] >= begin, state, np.nan)
            out[name] = y
        return out

    columns = ["_rn", *dict.fromkeys(c for c, _, _ in specs.values())]

    def ends(s: Series) -> dict:
        made = local(s, None)
        last = s.start + s.length - 1
        take = lambda c: s.table[c].combine_chunks().take(last)
        n, begins = s.length.astype(float), s.table["_rn"].to_numpy()[s.start]
        keep = {f"a_{k}": np.where(begins > begin, (1 - alpha) ** n, np.where(begins + s.length <= begin, 1.0, 0.0)) for k, (_, alpha, begin) in specs.items()}
        return {k: take(k) for k in group} | keep | {f"c_{k}": np.nan_to_num(made[k][last]) for k in names}

    kind = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kind[k]}" for k in group) + ", " + ", ".join(f"{p}_{k} double" for p in "ac" for k in names)
    summed = per_series(rows, group, "_rn", columns[1:], schema, ends, every_row=False)

    def step(s: Series, r: np.ndarray, now: np.ndarray) -> np.ndarray:
        return np.stack([s.values(f"a_{k}")[r] * now[i] + s.values(f"c_{k}")[r] for i, k in enumerate(names)])

    state = [f"s_{k}" for k in names]
    begins = cut(_through(summed, keys, state, step, [0.0] * len(names), [f"{p}_{k}" for p in "ac" for k in names]), "states")

    def fill(s: Series) -> dict[str, np.ndarray]:
        start = {k: s.values(f"s_{k}") for k in names}
        return local(s, start)

    told = meet(rows, begins, group)
    made = per_series(told, group, "_rn", [*columns[1:], *state], ", ".join(f"{k} double" for k in names), fill)
    return meet(rows, made, [*group, "_rn"])


def local_level(rows: DataFrame, keys: list[str], x: str, q: float, r: float) -> DataFrame:
    """rows (from ``blocked``) with level, gain and innovation of a random walk seen with noise; a missing value only widens the variance."""
    rows = cut(rows, "blocks")
    group = [*keys, "_block"]
    kind = dict(rows.dtypes)
    head = ", ".join(f"{k} {kind[k]}" for k in group)

    def ends_of(s: Series) -> dict:
        return {k: s.table[k].combine_chunks().take(s.start) for k in group}

    def variance(s: Series) -> dict:
        """The block as (a p + b) / (c p + d)."""
        v = s.values(x)
        m = np.zeros((4, len(s.ranked)))
        m[0] = m[3] = 1.0
        order = np.argsort(-s.length, kind="stable")
        for now in s.steps():
            n = len(now)
            seen = ~np.isnan(v[now])
            a, b, c, d = (np.where(seen, one, other) for one, other in ((r, 1.0), (q * r, q), (1.0, 0.0), (q + r, 1.0)))
            p = m[:, :n]
            new = np.stack([a * p[0] + b * p[2], a * p[1] + b * p[3], c * p[0] + d * p[2], c * p[1] + d * p[3]])
            m[:, :n] = new / np.abs(new).max(0)
        out = np.empty_like(m)
        out[:, order] = m
        return ends_of(s) | dict(zip("abcd", out, strict=True))

    maps = per_series(rows, group, "_rn", [x], head + ", a double, b double, c double, d double", variance, every_row=False)

    def widen(s: Series, now: np.ndarray, p: np.ndarray) -> np.ndarray:
        a, b, c, d = (s.values(k)[now] for k in "abcd")
        return ((a * p[0] + b) / (c * p[0] + d))[None]

    spread = cut(_through(maps, keys, ["_p"], widen, [1.0], list("abcd")), "states")

    def run(s: Series, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        v, p, m = s.values(x), s.values("_p")[s.ranked], level[s.ranked]
        out = np.full((3, len(v)), np.nan)
        keep = np.ones(len(s.ranked))
        for now in s.steps():
            n = len(now)
            wide = p[:n] + q
            seen = ~np.isnan(v[now])
            k, step = wide / (wide + r), v[now] - m[:n]
            out[1][now], out[2][now] = np.where(seen, k, np.nan), step
            m[:n] = np.where(seen, m[:n] + k * step, m[:n])
            p[:n] = np.where(seen, (1 - k) * wide, wide)
            keep[:n] *= np.where(seen, 1 - k, 1.0)
            out[0][now] = m[:n]
        back = np.argsort(-s.length, kind="stable")
        ends, held = np.empty_like(m), np.empty_like(keep)
        ends[back], held[back] = m, keep
        return *out, ends, held

    known = cut(meet(rows, spread, group), "blocks")

    def levels(s: Series) -> dict:
        *_, ends, held = run(s, np.zeros(len(s.row)))
        return ends_of(s) | {"a": held, "c": ends}

    sums = per_series(known, group, "_rn", [x, "_p"], head + ", a double, c double", levels, every_row=False)
    begins = cut(_through(sums, keys, ["_m"], lambda s, now, m: (s.values("a")[now] * m[0] + s.values("c")[now])[None], [0.0], ["a", "c"]), "states")

    def fill(s: Series) -> dict[str, np.ndarray]:
        level, gain, innovation, *_ = run(s, s.values("_m"))
        return {"level": level, "gain": gain, "innovation": innovation}

    made = per_series(meet(known, begins, group), group, "_rn", [x, "_p", "_m"], "level double, gain double, innovation double", fill)
    return meet(rows, made, [*group, "_rn"])


def indicators(panel: DataFrame, entity: str, time: str, price: str, rsi: int, fast: int, slow: int, signal: int, band: int, short: int, long: int) -> DataFrame:
    """What ``grouped.indicators`` gives, for series of any length."""
    rows = with_halo(blocked(panel.withColumn("_v", F.col(price).cast("double")), [entity], time, ["_v"]), max(band, short, long) + 1)
    part = Window.partitionBy(entity, "_block").orderBy("_rn")
    back = lambda n: part.rowsBetween(-(n - 1), 0)
    full = lambda n, c: F.when(F.col("_rn") >= n - 1, c)
    step = F.col("_v") - F.lag("_v").over(part)
    x = rows.withColumns({
        "_up": F.greatest(step, F.lit(0.0)), "_down": F.greatest(-step, F.lit(0.0)), "_mean": full(band, F.avg("_v").over(back(band))), "_sd": full(band, F.stddev_samp("_v").over(back(band))),
        "sma_short": full(short, F.avg("_v").over(back(short))), "sma_long": full(long, F.avg("_v").over(back(long))),
    })
    gap = F.col("sma_short") - F.col("sma_long")
    x = x.withColumn("_gap", gap).withColumn("_was", F.lag("_gap").over(part)).where("_own").drop("_own")
    x = emas(x, [entity], {"_u": ("_up", 1 / rsi, 1), "_d": ("_down", 1 / rsi, 1), "_f": ("_v", 2 / (fast + 1), 0), "_s": ("_v", 2 / (slow + 1), 0)})
    x = emas(x.withColumn("macd", F.col("_f") - F.col("_s")), [entity], {"macd_signal": ("macd", 2 / (signal + 1), 0)})
    cross = F.when((F.col("_gap") > 0) & (F.col("_was") <= 0), 1).when((F.col("_gap") < 0) & (F.col("_was") >= 0), -1).otherwise(0)
    upper, lower = F.col("_mean") + 2 * F.col("_sd"), F.col("_mean") - 2 * F.col("_sd")
    return x.select(
        entity, time, F.when((F.col("_rn") >= rsi) & (F.col("_d") != 0), 100 - 100 / (1 + F.col("_u") / F.col("_d"))).alias("rsi"), "macd", "macd_signal", (F.col("macd") - F.col("macd_signal")).alias("macd_hist"), upper.alias("bb_upper"), lower.alias("bb_lower"),
        F.when(F.col("_sd") > 0, (F.col("_v") - lower) / (4 * F.col("_sd"))).alias("bollinger"), "sma_short", "sma_long", cross.cast("int").alias("sma_cross"),
    )
