"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

log P(word | context) = log P(class | context) + log P(word | class, word before). Classes come from the ends of words.

The class softmax has hashed indicator features of the context: the word before (in buckets), its class, the class one
further back (a skip feature) and the pair of classes. It is fitted to the class events of every training token: those
are counted per context by a shuffle, and each gradient step runs over the counted events on the executors, which gives
the gradient over all tokens.

The word softmax inside a class has one hashed feature for each pair of a word and the real word before it, and one for
"none of these"; after the latter the word is drawn by its smoothed share of the class. So it is normalised inside the
class, and its features grow with the corpus. Pairs are counted by a shuffle on the hash of (word before, class), so
all features of one normaliser lie in one bucket, where gradient steps move them by observed minus expected counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernel import mix64, slices, words_of
from tessera.scratch import cut, shuffle_parts

CLASSES, SUB = 64, 4
END = CLASSES - 1  # class of the end token; the start of a text counts as one
CONTEXTS = CLASSES * SUB * CLASSES
SLICES = 16
HASHED, STEPS = 8192, 16
FEATURES = 5  # of each context
#: Gradients are summed in so many ranges of feature numbers.
RANGES = 16
#: Texts are dealt with in units of about this many bytes; a unit's words and pairs are distinct in its tables.
UNIT_BYTES = 4 << 20
#: Bytes of text for each bucket of words and pairs at most, so that a bucket doesn't grow with the corpus.
BUCKET_BYTES = 16 << 20
#: Gradient steps for pairs, and what each seen pair gives of its count to unseen ones.
PAIR_STEPS, DISCOUNT = 16, 0.75
_END_HASH, _START_HASH = np.uint64(0xE1D0C0FFEE123457), np.uint64(0x5EED0FA11BEEF123)
#: Words are told apart by 56 bits of hash; a pair's feature by its bucket, 26 bits of (word before, class) and 16 bits of the word.
_WORD, _BEFORE = np.uint64((1 << 56) - 1), np.uint64((1 << 40) - 1)
_UNIT = "kind int, unit long, bucket int, n int, a binary, b binary, c binary, d binary"
_NAMES = ["kind", "unit", "bucket", "n", "a", "b", "c", "d"]
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
TEXT, WORD, PAIR, EVENT, TOTAL = range(5)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*[(*r, *[None] * (len(_KINDS) - len(r))) for r in rows], strict=True), _KINDS, strict=True)], _NAMES)


def _row(*values) -> pa.RecordBatch:
    return _batch([values])


def _deal(key: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Bucket of each hash of so many bits, ascending with it."""
    return ((key >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _bounds(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The buckets of an ascending array that have elements, with their places."""
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    for s, e in zip(first, [*first[1:], len(bucket)], strict=True):
        yield int(bucket[s]), slice(s, e)


def _squeeze(x: np.ndarray, ascending: bool = False) -> bytes:
    """Integers by planes of equal bytes, compressed; of ascending ones the differences."""
    x = x.astype("<u8")
    if ascending:
        x[1:] = x[1:] - x[:-1]
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True) if len(x) else b""


def _expand(data: bytes, n: int, ascending: bool = False) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : data[0]] = np.frombuffer(pa.decompress(data[1:], decompressed_size=n * data[0], codec="zstd", asbytes=True), np.uint8).reshape(data[0], n).T
    x = out.view("<u8").ravel()
    return np.cumsum(x, dtype=np.uint64) if ascending else x


def pair_keys(words: np.ndarray, place: np.ndarray, cls: np.ndarray, first: np.ndarray, buckets: int) -> np.ndarray:
    """Feature number of each token with the word before it: its bucket in the top 16 bits, then the group, then the word."""
    before = np.empty(len(place), np.uint64)
    before[1:] = words[place[:-1]] & _BEFORE
    before[first] = _START_HASH & _BEFORE
    group = mix64(before * np.uint64(CLASSES) + cls[place].astype(np.uint64))
    word = mix64(words[place] + np.uint64(1)) & np.uint64((1 << 16) - 1)
    return _deal(group, 64, buckets).astype(np.uint64) << np.uint64(48) | (group & np.uint64((1 << 26) - 1)) << np.uint64(16) | word


def word_classes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class 0 to 62 of each word: by its last byte if that is a sign, else by its last two bytes."""
    last = data[end - 1].astype(np.uint64)
    before = np.where(end - start > 1, data[np.maximum(end - 2, 0)], 0).astype(np.uint64)
    letter = ((last >= 97) & (last <= 122)) | (last >= 128)
    return np.where(letter, 16 + mix64(last * np.uint64(256) + before) % np.uint64(CLASSES - 17), mix64(last + np.uint64(1 << 20)) % np.uint64(16)).astype(np.uint8)


def contexts(cls: np.ndarray, sub: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Context number of each token of some texts laid end to end; first: where each text begins."""
    one, two = np.empty(len(cls), np.int64), np.empty(len(cls), np.int64)
    both = cls.astype(np.int64) * SUB + sub
    one[1:], two[2:] = both[:-1], cls[:-2]
    one[first] = END * SUB
    two[:2] = END
    two[first] = END
    two[(first + 1)[first + 1 < len(cls)]] = END
    return one * CLASSES + two


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """TEXT: one unit's texts as numbers of distinct words, and those words' hashes and classes; EVENT: class events."""
    events = np.zeros(CONTEXTS * CLASSES, np.int64)
    part, serial = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts, ids, held = batch.column("text"), batch.column("doc_id"), batch.column("held").to_numpy(zero_copy_only=False)
        for i, j, raw0, off0 in slices(texts, UNIT_BYTES):
            hashes, classes, counts = [], [], []
            for _, _, raw, off in slices(texts.slice(i, j - i)):
                w = words_of(raw, off)
                # The end token goes behind the words of each text.
                at = w.first[1:] + np.arange(len(w.count))
                h = np.empty(len(w.hash) + len(w.count), np.uint64)
                c = np.empty(len(h), np.uint8)
                is_end = np.zeros(len(h), bool)
                is_end[at] = True
                h[is_end], c[is_end] = _END_HASH & _WORD, END
                h[~is_end], c[~is_end] = w.hash & _WORD, word_classes(w.data, w.start, w.end)
                hashes.append(h), classes.append(c), counts.append(w.count + 1)
            h, c, n = np.concatenate(hashes), np.concatenate(classes), np.concatenate(counts)
            words, once, place = np.unique(h, return_index=True, return_inverse=True)
            train = np.repeat(~held[i:j], n)
            ctx = contexts(c, (h & np.uint64(SUB - 1)).astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
            np.add.at(events, ctx[train] * CLASSES + c[train], 1)
            unit, serial = (part << 32) + serial, serial + 1
            known = ids.slice(i, j - i)
            flags = held[i:j].astype(np.uint64) | known.is_null().to_numpy(zero_copy_only=False).astype(np.uint64) << np.uint64(1) | n.astype(np.uint64) << np.uint64(2)
            # Frequent words get small numbers, so that the planes of texts compress.
            rank = np.argsort(-np.bincount(place), kind="stable")
            number = np.empty(len(rank), np.int64)
            number[rank] = np.arange(len(rank))
            yield _row(TEXT, unit, len(words), len(n), known.fill_null(0).to_numpy().tobytes(), _squeeze(flags), _squeeze(number[place]), _squeeze(words[rank] | c[once[rank]].astype(np.uint64) << np.uint64(56)))
    width = CONTEXTS // SLICES * CLASSES
    for k in range(SLICES):
        some = np.flatnonzero(events[k * width : (k + 1) * width])
        if len(some):
            yield _row(EVENT, k, k, len(some), _squeeze(some, True), _squeeze(events[k * width + some]))


@dataclass
class _Texts:
    """A unit's texts: doc_ids, held out, null ids, tokens, first token; words in order of hash, their classes and the tokens' words."""

    ids: np.ndarray
    held: np.ndarray
    null: np.ndarray
    n: np.ndarray
    first: np.ndarray
    words: np.ndarray
    cls: np.ndarray
    place: np.ndarray

    @staticmethod
    def read(distinct: int, docs: int, a: bytes, b: bytes, c: bytes, d: bytes) -> _Texts:
        flags = _expand(b, docs)
        n = (flags >> np.uint64(2)).astype(np.int64)
        told = _expand(d, distinct)
        order = np.argsort(told & _WORD)
        number = np.empty(distinct, np.int64)
        number[order] = np.arange(distinct)
        place = number[_expand(c, int(n.sum())).astype(np.int64)]
        return _Texts(np.frombuffer(a, np.int64), (flags & np.uint64(1)).astype(bool), (flags & np.uint64(2)).astype(bool), n, np.concatenate([[0], np.cumsum(n)[:-1]]), told[order] & _WORD, (told[order] >> np.uint64(56)).astype(np.uint8), place)


def _ask(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """WORD, PAIR: each unit's distinct words and pairs, in order of hash, by bucket, with their counts in training texts."""
    for batch in batches:
        for unit, *r in zip(*(batch.column(c).to_pylist() for c in ("unit", "bucket", "n", "a", "b", "c", "d")), strict=True):
            t = _Texts.read(*r)
            train = np.repeat(~t.held, t.n)
            count = np.bincount(t.place[train], minlength=len(t.words))
            rows = [(WORD, unit, k, at.stop - at.start, _squeeze(t.words[at], True), _squeeze(count[at]), _squeeze(t.cls[at])) for k, at in _bounds(_deal(t.words, 56, buckets))]
            pairs, where = np.unique(pair_keys(t.words, t.place, t.cls, t.first, buckets), return_inverse=True)
            count = np.bincount(where[train], minlength=len(pairs))
            low = pairs & np.uint64((1 << 48) - 1)
            rows += [(PAIR, unit, k, at.stop - at.start, _squeeze(low[at], True), _squeeze(count[at])) for k, at in _bounds((pairs >> np.uint64(48)).astype(np.int64))]
            yield _batch(rows)


def fit_pairs(group: np.ndarray, count: np.ndarray, steps: int = PAIR_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each pair and of "none of these" in its group (ascending numbers), by gradient steps on their weights.

    A group is a softmax over its seen pairs and one more item. Of each pair's count DISCOUNT goes to that item, which
    so has an observed count too. A step moves each weight by observed minus expected, less a little of itself, over
    the larger of both. Pairs without a count have probability 0; a group without any gives the item 1.
    """
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    where = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)]))
    seen = count > 0
    kept = np.where(seen, count - DISCOUNT, 0.0)
    none = np.add.reduceat(np.where(seen, DISCOUNT, 0.0), first)
    total = np.add.reduceat(kept, first) + none
    weight, base = np.zeros(len(group)), np.zeros(len(first))
    for step in range(steps + 1):
        share = np.where(seen, np.exp(weight), 0.0)
        floor = np.exp(base)
        norm = np.add.reduceat(share, first) + floor
        share, floor = share / norm[where], floor / norm
        if step < steps:
            expected, idle = total[where] * share, total * floor
            weight += (kept - expected - 0.01 * weight) / np.maximum(np.maximum(kept, expected), 0.25)
            base += (none - idle - 0.01 * base) / np.maximum(np.maximum(none, idle), 0.25)
            top = np.maximum(np.maximum.reduceat(np.where(seen, weight, -np.inf), first), base)
            weight, base = weight - top[where], base - top
    return share, floor[where]


def _code(p: np.ndarray) -> np.ndarray:
    """A probability in steps of 1/2048 of a bit of its logarithm, up to 65,535; 0 for none."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(1 + np.rint(-2048 * np.log2(np.minimum(p, 1))), 65535), 0).astype(np.uint64)


def _decode(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, np.exp2((1 - code.astype(np.float64)) / 2048), 0.0)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over all units: counts of each bucket's words and class totals, and fitted pairs.

    Rows come sorted by bucket and kind. What is told of a unit's words or pairs has the order in which they came.
    """

    def joined(rows: list[tuple], k: int, ascending: bool = False) -> np.ndarray:
        return np.concatenate([_expand(r[k], r[3], ascending) for r in rows])

    def words(rows: list[tuple]) -> list[tuple]:
        names, once, place = np.unique(joined(rows, 4, True), return_index=True, return_inverse=True)
        total = np.zeros(len(names), np.int64)
        np.add.at(total, place, joined(rows, 5).astype(np.int64))
        cls = joined(rows, 6)[once].astype(np.int64)
        tokens, distinct = np.zeros(CLASSES, np.int64), np.bincount(cls[total > 0], minlength=CLASSES)
        np.add.at(tokens, cls, total)
        out, told, at = [(TOTAL, 0, rows[0][2], 0, tokens.astype("<i8").tobytes(), distinct.astype("<i8").tobytes())], total[place], 0
        for r in rows:
            out.append((WORD, r[1], r[2], r[3], _squeeze(told[at : at + r[3]])))
            at += r[3]
        return out

    def pairs(rows: list[tuple]) -> list[tuple]:
        key, place = np.unique(joined(rows, 4, True), return_inverse=True)
        count = np.zeros(len(key))
        np.add.at(count, place, joined(rows, 5).astype(float))
        one, none = (_code(p)[place] for p in fit_pairs(key >> np.uint64(16), count))
        out, at = [], 0
        for r in rows:
            out.append((PAIR, r[1], r[2], r[3], _squeeze(one[at : at + r[3]]), _squeeze(none[at : at + r[3]])))
            at += r[3]
        return out

    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("kind", "unit", "bucket", "n", "a", "b", "c")), strict=True):
            if held and (held[0][0], held[0][2]) != (r[0], r[2]):
                yield _batch((words if held[0][0] == WORD else pairs)(held))
                held = []
            held.append(r)
    if held:
        yield _batch((words if held[0][0] == WORD else pairs)(held))


def _sum_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dense sums of the events of each slice of contexts."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, n, a, b in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "a", "b")), strict=True):
            dense = sums.setdefault(k, np.zeros(CONTEXTS // SLICES * CLASSES, np.int64))
            dense[_expand(a, n, True).astype(np.int64)] += _expand(b, n).astype(np.int64)
    for k, dense in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([dense.astype("<i8").tobytes()], pa.binary())], ["bucket", "a"])


def features(ctx: np.ndarray) -> np.ndarray:
    """Hashed feature numbers of each context: bias, bucketed word before, its class, class before that, pair of classes."""
    before, two = ctx // CLASSES, ctx % CLASSES
    one = before // SUB
    raw = np.stack([np.zeros_like(ctx), before, one, two, one * CLASSES + two], 1).astype(np.uint64)
    return (mix64(raw + (np.arange(1, 6, dtype=np.uint64) << np.uint64(40))) % np.uint64(HASHED)).astype(np.int64)


def _log_softmax(weights: np.ndarray, feats: np.ndarray) -> np.ndarray:
    s = weights[feats].sum(1)
    s -= s.max(1, keepdims=True)
    return s - np.log(np.exp(s).sum(1, keepdims=True))


def _partial(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Observed and expected counts per feature and class over a task's contexts, by range of features."""
    seen, expected = np.zeros((HASHED, CLASSES)), np.zeros((HASHED, CLASSES))
    for batch in batches:
        for k, a in zip(batch.column("bucket").to_pylist(), batch.column("a").to_pylist(), strict=True):
            counts = np.frombuffer(a, "<i8").reshape(-1, CLASSES).astype(np.float64)
            some = np.flatnonzero(counts.sum(1))
            f = features(k * (CONTEXTS // SLICES) + some)
            p = np.exp(_log_softmax(weights, f)) * counts[some].sum(1, keepdims=True)
            for c in range(FEATURES):
                np.add.at(seen, f[:, c], counts[some])
                np.add.at(expected, f[:, c], p)
    width = HASHED // RANGES
    for k in range(RANGES):
        at = slice(k * width, (k + 1) * width)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([seen[at].tobytes()], pa.binary()), pa.array([expected[at].tobytes()], pa.binary())], ["range", "seen", "expected"])


def _step(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """New weights of each range of features from the sums of its partial counts."""
    sums: dict[int, np.ndarray] = {}
    width = HASHED // RANGES
    for batch in batches:
        for k, *both in zip(*(batch.column(c).to_pylist() for c in ("range", "seen", "expected")), strict=True):
            sums.setdefault(k, np.zeros((2, width, CLASSES)))
            for i in (0, 1):
                sums[k][i] += np.frombuffer(both[i], "<f8").reshape(width, CLASSES)
    for k, (seen, expected) in sums.items():
        old = weights[k * width : (k + 1) * width]
        new = old + (seen - expected - 0.01 * old) / (FEATURES * np.maximum(seen, expected) * 0.5 + 1)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([new.tobytes()], pa.binary())], ["range", "weights"])


def train(events: DataFrame, steps: int = STEPS) -> np.ndarray:
    """Weights (HASHED, CLASSES) after ``steps`` distributed gradient steps over the counted events.

    Each step sends the weights out, sums observed and expected counts per feature and class by a shuffle on ranges of
    features and moves each weight there by observed minus expected over their size, over the number of features of a
    context so that it can't overshoot. The driver gets the new weights only, once a step, whatever the number of tasks.
    """
    spark = events.sparkSession
    weights = np.zeros((HASHED, CLASSES), np.float64)
    for _ in range(steps):
        told = spark.sparkContext.broadcast(weights)
        parts = events.select("bucket", "a").mapInArrow(lambda b, told=told: _partial(b, told.value), "range int, seen binary, expected binary")
        moved = parts.repartition(RANGES, "range").mapInArrow(lambda b, told=told: _step(b, told.value), "range int, weights binary")
        weights = weights.copy()
        for r in moved.collect():  # 4 MB in all
            weights[r.range * (HASHED // RANGES) : (r.range + 1) * (HASHED // RANGES)] = np.frombuffer(r.weights, "<f8").reshape(-1, CLASSES)
        told.destroy()
    return weights


@dataclass
class Model:
    class_log10: np.ndarray  # (CONTEXTS, CLASSES) float32
    word_base: np.ndarray  # log10 of each class's denominator
    tokens: int
    distinct: int
    buckets: int


def _score(batches: Iterator[pa.RecordBatch], told) -> Iterator[pa.RecordBatch]:
    """Joins each unit's texts with what is told of its words and pairs; a unit's rows come together, texts first, then by bucket."""

    def solve(text: tuple, found: dict[int, list[tuple]], m: Model) -> pa.RecordBatch:
        t = _Texts.read(*text[2:])
        count = np.concatenate([_expand(r[4], r[3]) for r in found[WORD]]).astype(np.float64)
        keys, where = np.unique(pair_keys(t.words, t.place, t.cls, t.first, m.buckets), return_inverse=True)
        one, none = (np.concatenate([_decode(_expand(r[k], r[3])) for r in found[PAIR]]) for k in (4, 5))
        if len(count) != len(t.words) or len(one) != len(keys):
            raise ValueError("a unit lacks some of its words' or pairs' counts")
        log = np.log10(count + 0.5)
        c = t.cls[t.place]
        ctx = contexts(c, (t.words[t.place] & np.uint64(SUB - 1)).astype(np.int64), t.first)
        inside = one[where] + none[where] * 10 ** (log - m.word_base[t.cls])[t.place]
        model = np.add.reduceat(m.class_log10[ctx, c].astype(np.float64) + np.log10(np.minimum(inside, 1)), t.first)
        known = np.add.reduceat((count > 0)[t.place].astype(np.int64), t.first)
        base = np.add.reduceat(log[t.place], t.first) - t.n * np.log10(m.tokens + 0.5 * (m.distinct + 1))
        return pa.RecordBatch.from_arrays([pa.array(t.ids, mask=t.null), pa.array(t.held), pa.array(t.n), pa.array(known), pa.array(np.full(len(t.n), m.tokens)), pa.array(base), pa.array(model)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    text, found = None, {WORD: [], PAIR: []}
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("kind", "unit", "bucket", "n", "a", "b", "c", "d")), strict=True):
            if r[0] == TEXT:
                if text is not None:
                    yield solve(text, found, told.value)
                text, found = r, {WORD: [], PAIR: []}
            else:
                found[r[0]].append(r)
    if text is not None:
        yield solve(text, found, told.value)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    Tokens: the text's words with A-Z lower-cased, then one end. A null text has the end only; a null doc_id is not
    held out. Scores are base-10 logs. A word that training lacks takes its class's share of unseen words. Without any
    training text, counts are zero and the class model is uniform. Texts are read once: units of them are written as
    numbers of their distinct words; only a unit's distinct words and pairs are shuffled for counts, so a very frequent
    one costs an entry per unit. Buckets follow the bytes of the texts.
    """
    spark = docs.sparkSession
    n = shuffle_parts(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(32767, max(32, n, -(-size // BUCKET_BYTES)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held"))
    units = cut(rows.mapInArrow(_units, _UNIT), "units")
    texts = units.where(F.col("kind") == TEXT)
    asked = texts.mapInArrow(lambda b: _ask(b, buckets), _UNIT)
    solved = cut(asked.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_solve, _UNIT), "solved")
    weights = train(cut(units.where(F.col("kind") == EVENT).select("bucket", "n", "a", "b").repartition(SLICES, "bucket").mapInArrow(_sum_events, "bucket int, a binary"), "events"))
    tokens, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in solved.where(F.col("kind") == TOTAL).select("a", "b").toLocalIterator():  # 1 kB for each bucket
        tokens += np.frombuffer(r.a, "<i8")
        distinct += np.frombuffer(r.b, "<i8")
    logs = np.concatenate([_log_softmax(weights, features(np.arange(k, min(k + 2048, CONTEXTS)))) for k in range(0, CONTEXTS, 2048)])
    told = spark.sparkContext.broadcast(Model((logs / np.log(10)).astype(np.float32), np.log10(tokens + 0.5 * (distinct + 1)), int(tokens.sum()), int(distinct.sum()), buckets))

    both = texts.unionByName(solved.where(F.col("kind") != TOTAL)).repartition(n, "unit").sortWithinPartitions("unit", "kind", "bucket")
    return both.mapInArrow(lambda b: _score(b, told), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
