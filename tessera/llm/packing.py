"""Best-fit decreasing packing of tokenized documents into windows of equal length.

Overlong documents are first cut into full windows; what is left of each is a piece shorter than a window. Pieces of one
length are interchangeable, so best fit works on the counts of lengths: windows of the same remaining capacity stand
together in runs, a segment tree indexed by remaining capacity finds the tightest run, and a run takes as many pieces of
the present length as fit. That is item-by-item best-fit decreasing over all documents at once, and its plan has a size
bound that doesn't depend on their number: each length leaves at most three runs more, and one window holds at most 45
different lengths up to 1,024, so there are under 140,000 rows of the plan at that capacity. Pieces find their place by
their number among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tokens import ByteEncoder, text_slices
from tessera.scratch import cut

CAPACITY = 1024
END_ID = 0


class Capacities:
    """A segment tree over remaining capacities 0 to n: which of them have an open run."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.any = bytearray(2 * self.leaves)

    def mark(self, capacity: int, is_open: bool) -> None:
        i = self.leaves + capacity
        self.any[i] = is_open
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The least capacity of at least ``length`` with an open run."""
        i = self.leaves + length
        if self.any[i]:
            return length
        while i > 1:
            if not i & 1 and self.any[i + 1]:  # a left child whose sibling holds larger capacities
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """The plan for so many pieces of each length: rows (length, first, window, each, used) in order of length, then first.

    Pieces first, first + 1, ... of the length, up to the next row's first, go ``each`` to a window from ``window`` on,
    where ``used`` tokens lie before them. Windows are numbered from 0 without gaps.
    """
    tree, runs = Capacities(capacity), {}  # capacity -> runs (first window, windows)
    rows, opened = [], 0

    def put(left: int, window: int, n: int) -> None:
        if n and left:
            runs.setdefault(left, []).append((window, n))
            tree.mark(left, True)

    for length in sorted(counts, reverse=True):
        first, todo = 0, counts[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                left = capacity
                window, n = opened, -(-todo // (capacity // length))
                opened += n
            else:
                window, n = runs[left].pop()
                if not runs[left]:
                    tree.mark(left, False)
            each = left // length
            rows.append((length, first, window, each, capacity - left))
            full, part = divmod(min(todo, n * each), each)
            put(left - each * length, window, full)
            if part:
                put(left - part * length, window + full, 1)
            put(left, window + full + (part > 0), n - full - (part > 0))
            first += full * each + part
            todo -= full * each + part
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of each row's tokens: doc_id, start, length, ids_crc32, doc_tokens, part and k (its number among those of its length in part), and the ids if asked for.

    A document's tokens are the tokenizer's ids of its whole text (null: empty) and END_ID. One pass, no shuffle; the
    tokenizer's file must be readable on the executors.
    """
    ints = ("start", "length", "ids_crc32", "doc_tokens", "part", "k")
    more = [T.StructField("ids", T.BinaryType())] if keep_ids else []
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ints), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(tokenizer_file, special=True)
        part, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            for i, texts in text_slices(b.column("_text")):
                encoded = [x.tobytes() + END_ID.to_bytes(4, "little") for x in encoder.encode(texts)]
                tokens = np.array([len(x) // 4 for x in encoded], np.int64)
                pieces = -(-tokens // capacity)
                doc = np.repeat(np.arange(len(texts)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(tokens[doc] - start, capacity)
                held = [encoded[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                grouped = length[order]
                k = np.empty(len(doc), np.int64)
                k[order] = met[grouped] + np.arange(len(doc)) - np.searchsorted(grouped, grouped)
                met += np.bincount(length, minlength=capacity + 1)
                columns = [start, length, np.array([zlib.crc32(x) for x in held], np.int64), tokens[doc], np.full(len(doc), part, np.int64), k]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc + i)), *map(pa.array, columns), *([pa.array(held, pa.binary())] if keep_ids else [])], names=schema.names)

    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, schema)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset for their part and k.

    The driver sees one count for each length and makes the plan; numbers inside a part become numbers among all pieces
    of the length by sums over parts. No key holds more rows than one task of cut_pieces made, and no text or id moves.
    """
    each = cut(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r.length: r.n for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row for each length up to the capacity
    plan = best_fit(counts, capacity)
    told = pieces.sparkSession.sparkContext.broadcast(plan)
    before = each.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.expr("coalesce(sum(n) OVER (PARTITION BY length ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)").alias("_before"))
    numbered = pieces.join(before, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length"))).drop("_part", "_length")
    schema = T.StructType([*numbered.drop("part", "k", "_before").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = told.value
        starts = np.append(np.searchsorted(rows[:, 0], np.arange(capacity + 2)), len(rows))
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("k").to_numpy() + b.column("_before").to_numpy()
            at = np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for n in np.unique(length):  # at most one step for each length
                here = order[np.searchsorted(length[order], n) : np.searchsorted(length[order], n, "right")]
                lo, hi = starts[n], starts[n + 1]
                at[here] = lo + np.searchsorted(rows[lo:hi, 1], rank[here], "right") - 1
            _, first, window, per, used = rows[at].T
            kept = [b.column(c) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(window + (rank - first) // per), pa.array(used + (rank - first) % per * length)], names=schema.names)

    return numbered.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of every row of docs (doc_id, text).

    Null and empty texts are one piece of the end id alone; repeated rows are packed one by one; other columns are left
    out; an empty table gives an empty one. Sequence ids and offsets have no gaps. Which of several pieces of one length
    goes to which window follows the order of the input's partitions.
    """
    pieces = cut(cut_pieces(docs, tokenizer_file, capacity), "pieces")
    return place(pieces, capacity)


def packed_sequences(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """The windows themselves: sequence_id, n_tokens, ids (little-endian unsigned 32-bit integers, not padded) and pieces, a list of (offset, length, doc_id, start)."""
    pieces = cut(cut_pieces(docs, tokenizer_file, capacity, keep_ids=True), "pieces")
    rows = place(pieces, capacity).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("p"))  # a window holds at most `capacity` pieces
    return rows.select("sequence_id", F.expr("aggregate(p, 0L, (n, x) -> n + x.length)").alias("n_tokens"), F.expr("aggregate(p, cast('' AS binary), (b, x) -> concat(b, x.ids))").alias("ids"), F.expr("transform(p, x -> named_struct('offset', x.offset, 'length', x.length, 'doc_id', x.doc_id, 'start', x.start))").alias("pieces"))
