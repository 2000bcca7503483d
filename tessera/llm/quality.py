"""Quality classifier as a sparse rule ensemble: tree paths over text statistics, lasso logistic weights, Spark expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.kernel import distinct_sorted, slices, words_of
from tessera.scratch import cut

#: Labelled rows that the fit takes at most, the first by hash of doc_id; the statistics and the scoring cover every row.
SAMPLE_ROWS = 20_000
STATS = ["log_bytes", "log_words", "word_bytes", "upper", "digit", "punct", "pipe", "symbol", "nonascii", "distinct", "line_words", "repeated_lines", "end_marks", "short_words", "long_words", "shout_words", "repeats"]


def _per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[bounds[1:]] - total[bounds[:-1]]


_KIND = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "punct": np.isin(np.arange(256), list(b".,;:!?'\"-()")),
    "pipe": np.arange(256) == 124,
    "symbol": np.isin(np.arange(256), list(b"#$%&*+/<=>@[\\]^_`{|}~!")),
    "nonascii": np.arange(256) >= 128,
    "line": np.arange(256) == 10,
}


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATS for each text; a null or empty text has zeros."""
    parts = []
    for _, _, raw, off in slices(texts):
        w = words_of(raw, off)
        size, words = np.maximum(w.size, 1), np.maximum(w.count, 1)
        share = {k: _per_text(m[raw], off) for k, m in _KIND.items()}
        d, _ = distinct_sorted(w.doc, w.hash)
        length = w.end - w.start
        per_word = lambda mask: np.bincount(w.doc[mask], minlength=len(off) - 1)
        last = raw[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
        upper = np.concatenate([[0], np.cumsum(_KIND["upper"][raw])])
        # Lines: the sum of the word hashes and the place of each word in its line stand for the line.
        breaks = np.concatenate([[0], np.cumsum(_KIND["line"][raw])])
        line = breaks[w.start] + w.doc if len(w.start) else np.zeros(0, np.int64)
        new = np.ones(len(line), bool)
        new[1:] = line[1:] != line[:-1]
        at = np.flatnonzero(new)
        sums = np.add.reduceat(w.hash * (np.arange(len(line)) - at[np.cumsum(new) - 1] + 1).astype(np.uint64), at) if len(at) else np.zeros(0, np.uint64)
        line_doc = w.doc[at]
        again = np.zeros(len(w.hash), bool)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        lines = np.bincount(line_doc, minlength=len(off) - 1)
        unique, _ = distinct_sorted(line_doc, sums)
        parts.append(np.stack([
            np.log1p(w.size), np.log1p(w.count), np.bincount(w.doc, length, len(off) - 1) / words, share["upper"] / size, share["digit"] / size, share["punct"] / size, share["pipe"] / words, share["symbol"] / words, share["nonascii"] / size,
            np.bincount(d, minlength=len(off) - 1) / words, w.count / np.maximum(lines, 1), (lines - np.bincount(unique, minlength=len(off) - 1)) / np.maximum(lines, 1),
            per_word(np.isin(last, list(b"#$%&*!"))) / words, per_word(length <= 3) / words, per_word(length >= 12) / words, per_word((upper[w.end] - upper[w.start] >= 2) if len(w.end) else np.zeros(0, bool)) / words, per_word(again) / words,
        ], 1))
    return np.concatenate(parts) if parts else np.zeros((0, len(STATS)))


def with_statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep and the STATS of every row of df."""
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), *(T.StructField(s, T.DoubleType()) for s in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column("_text"))
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in fields] + [pa.array(np.ascontiguousarray(x[:, k])) for k in range(len(STATS))], [*(f.name for f in fields), *STATS])

    return df.select(*[F.col(f"`{f.name}`") for f in fields], F.col(text).alias("_text")).mapInArrow(run, schema)


@dataclass
class RuleModel:
    """score = sigmoid(bias + sum of the weights of the rules that hold); a rule is a list of (statistic, '<=' or '>', value)."""

    bias: float
    rules: list[tuple[list[tuple[str, str, float]], float]] = field(default_factory=list)

    def column(self) -> Column:
        """The score as one Spark column expression over the statistics."""
        total = F.lit(float(self.bias))
        for terms, weight in self.rules:
            holds = F.lit(True)
            for name, op, value in terms:
                holds = holds & ((F.col(name) <= F.lit(value)) if op == "<=" else (F.col(name) > F.lit(value)))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, features: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, path: list, out: list) -> None:
    """Grows one regression tree greedily and records the path to each node."""
    if depth == 0 or len(rows) < 2 * least:
        return
    r, best = residual[rows], (1e-9, -1, 0.0)
    total, n = r.sum(), len(rows)
    for f in features:
        if not len(cuts[f]):
            continue
        b = np.searchsorted(cuts[f], x[rows, f], "left")
        count, sums = np.cumsum(np.bincount(b, minlength=len(cuts[f]) + 1))[:-1], np.cumsum(np.bincount(b, r, len(cuts[f]) + 1))[:-1]
        ok = (count >= least) & (n - count >= least)
        gain = np.where(ok, sums**2 / np.maximum(count, 1) + (total - sums) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
        if gain.max() > best[0]:
            best = (gain.max(), f, float(cuts[f][gain.argmax()]))
    if best[1] < 0:
        return
    _, f, v = best
    for op, mask in (("<=", x[rows, f] <= v), (">", x[rows, f] > v)):
        out.append([*path, (STATS[f], op, v)])
        _tree(x, residual, rows[mask], features, cuts, depth - 1, least, [*path, (STATS[f], op, v)], out)


def _holds(x: np.ndarray, rules: list) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, terms in enumerate(rules):
        for name, op, v in terms:
            c = x[:, STATS.index(name)]
            out[:, k] *= (c <= v) if op == "<=" else (c > v)
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, seed: int = 3) -> RuleModel:
    """Rules are the paths of boosted trees on random halves; proximal gradient steps (FISTA) fit the lasso logistic weights."""
    if not len(y):
        return RuleModel(0.0)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return RuleModel(bias)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 49), method="nearest")) for k in range(x.shape[1])]
    margin, paths = np.full(len(y), bias), []
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-margin))
        rows = rng.permutation(len(y))[: max(20, len(y) // 2)]
        new: list = []
        _tree(x, residual, np.sort(rows), rng.permutation(x.shape[1])[:10], cuts, depth, max(5, len(y) // 200), [], new)
        if not new:
            continue
        held = _holds(x, new)
        for k, terms in enumerate(new):
            leaf = not any(len(t) > len(terms) and t[: len(terms)] == terms for t in new)
            if leaf and held[:, k].any():
                on = held[:, k] > 0
                p = 1 / (1 + np.exp(-margin[on]))
                margin[on] += 0.3 * np.clip((y[on] - p).sum() / max((p * (1 - p)).sum(), 1e-6), -4, 4)
        paths += new
    rules = list({tuple(sorted(t)): t for t in paths}.values())
    z = _holds(x, rules)
    some = (z.mean(0) > 0) & (z.mean(0) < 1)
    rules, z = [r for r, s in zip(rules, some, strict=True) if s], z[:, some]
    if not rules:
        return RuleModel(bias)
    v = np.ones(z.shape[1]) / np.sqrt(z.shape[1])
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * (np.linalg.norm(z @ v) ** 2 / len(y) + 1))
    w = seen = np.zeros(z.shape[1])
    b = seen_b = bias
    t = 1.0
    for _ in range(400):
        g = 1 / (1 + np.exp(-(seen_b + z @ seen))) - y
        u = seen - step * (z.T @ g) / len(y)
        new_w, new_b = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0), seen_b - step * g.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        seen, seen_b = new_w + (t - 1) / t2 * (new_w - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new_w, new_b, t2
    return RuleModel(float(b), [(r, float(c)) for r, c in zip(rules, w, strict=True) if abs(c) > 1e-6])


def held_out(doc_id: Column, parts: int = 3) -> Column:
    """True where crc32 of the id as text leaves remainder 1; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == 1, F.lit(False))


def sample_labels(labels: DataFrame, label: str = "quality", sample: int = SAMPLE_ROWS) -> DataFrame:
    """(_id, _y) of labelled ids outside the held-out third: all, or those below a hash cut that leaves about 1.1 times ``sample``.

    The cut follows from a count, so what later reaches the driver is bounded, however many tasks or labels there are.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(label).alias("_y")).where(F.col("_id").isNotNull() & ~held_out(F.col("_id"))).distinct()
    n = known.count()
    return known if n <= sample else known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < F.lit(int(1.1 * sample / n * (1 << 40))))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", sample: int = SAMPLE_ROWS) -> RuleModel:
    """Fits on at most ``sample`` labelled rows outside the held-out third, the first by hash of doc_id; equal rows count once.

    Only the sampled rows' statistics are computed: their ids, bounded in number, are broadcast.
    """
    known = cut(sample_labels(labels, label, sample), "labels")
    chosen = docs.select("doc_id", F.col(text).alias("_words")).join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    rows = with_statistics(chosen, "_words", ["_id", "_y"]).distinct().withColumn("_h", F.pmod(F.xxhash64("_id"), F.lit(1 << 40)))
    rows = cut(rows, "sample")
    n = rows.count()
    if n > 2 * sample:  # some ids stand on very many different texts
        rows = rows.where(F.pmod(F.xxhash64("_id", *STATS), F.lit(1 << 40)) < F.lit(int(1.1 * sample / n * (1 << 40))))
    found = rows.orderBy("_h", "_id", "_y", *STATS).limit(sample).toPandas()
    return fit(found[STATS].to_numpy(float), found["_y"].to_numpy(float))


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; null and empty texts are scored by their zero statistics.

    The model's rules are Spark column expressions over the statistics, which are computed for every whole text in one
    pass without a shuffle. Without labelled rows the score is 0.5. Repeated rows get equal scores.
    """
    score = train(docs, labels, text).column()
    stats = with_statistics(docs, text, ["doc_id"])
    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text the classifier doesn't reject, with docs' columns."""
    names = docs.columns
    score = train(docs, labels, text).column()
    at = names.index(text)
    schema = T.StructType([T.StructField("_row", docs.schema), *(T.StructField(s, T.DoubleType()) for s in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("_row")
            x = statistics(rows.field(at))
            yield pa.RecordBatch.from_arrays([rows, *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(len(STATS)))], ["_row", *STATS])

    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    return wrapped.mapInArrow(run, schema).where(score >= 0.5).select("_row.*")
