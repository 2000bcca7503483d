"""Alignment of two tokenizers over whole texts, and how often pairs of their tokens meet.

A text's tokens are lists in Arrow: flattened with the index of their document, their byte lengths summed from the start
of each document, and joined by Acero on (document, end). Common ends cut both token rows into groups; a second join on
the group gives the links. Table.group_by counts them per document and pair, and per task the documents of each pair;
Spark adds the tasks' counts up.

Corpus-wide counts come back to the documents in two ways: the most frequent pairs, at most HEAD_PAIRS of them, are
broadcast, and a document's other pairs are joined with the counts by shuffle. Both together cover every pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import ByteEncoder, text_slices
from tessera.scratch import cut, discard

#: Pairs whose counts are broadcast: 12 bytes each.
HEAD_PAIRS = 1_000_000
#: Pairs that a task counts before it hands the counts on.
HELD_PAIRS = 1_000_000
#: Links of a group from which equal ids are counted before they are joined.
LARGE_GROUP = 4096
MARK = "▁"
_DOC = "doc_id {}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class PieceEncoder:
    """Ids of a sentencepiece model without begin and end, and the bytes that each stands for."""

    def __init__(self, file: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=file)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.lib.encode(texts, num_threads=1)

    def bytes_of_ids(self) -> list[bytes]:
        pieces = map(self.lib.id_to_piece, range(self.lib.get_piece_size()))
        return [bytes.fromhex(p[3:5]) if self.lib.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]


class Side:
    """One tokenizer's tables by id, and its tokens of a batch as flat columns."""

    def __init__(self, encoder: ByteEncoder | PieceEncoder):
        self.encoder = encoder
        stands_for = encoder.bytes_of_ids()
        self.bytes = pa.array(stands_for, pa.large_binary())
        self.sizes = pa.array([len(x) for x in stands_for], pa.int64())
        self.decimal = pa.array([str(i) for i in range(len(stands_for))], pa.large_string())

    def tokens(self, encoded: list, whole: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """ids, document and end of each token, and which documents the tokens' bytes give back."""
        off = np.concatenate([[0], np.cumsum([len(x) for x in encoded])])
        flat = np.concatenate([np.asarray(x, np.int64) for x in encoded]) if len(encoded) else np.zeros(0, np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(off, pa.int64()), pa.array(flat, pa.int64()))
        ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        sums = pc.cumulative_sum(self.sizes.take(ids)).to_numpy() if len(ids) else np.zeros(0, np.int64)
        at = np.concatenate([[0], sums])[off]  # bytes before each document
        joined = self.bytes.take(ids)
        data = joined.buffers()[2].to_pybytes() if len(joined) and joined.buffers()[2] is not None else b""
        ok = np.array([data[i:j] == w for i, j, w in zip(at[:-1].tolist(), at[1:].tolist(), whole, strict=True)], bool)
        return ids, doc, sums - at[:-1][doc], ok


def _links(group: np.ndarray, ids: np.ndarray, other_group: np.ndarray, other_ids: np.ndarray) -> pa.Table:
    """(group, a, b, n): the pairs of ids in each group, tokens given in order of their groups.

    Groups of one token each way, which are most, are pairs as they stand; the others are joined. Groups of many links
    are counted by id first, so equal ids meet once.
    """
    n = int(max(group[-1], other_group[-1])) + 1
    left, right = np.bincount(group, minlength=n), np.bincount(other_group, minlength=n)
    one, large = (left == 1) & (right == 1), left * right > LARGE_GROUP

    def side(g: np.ndarray, x: np.ndarray, name: str, big: bool) -> pa.Table:
        here = large[g] if big else ~(large | one)[g]
        t = pa.table({"group": g[here], name: x[here]})
        return t.group_by(["group", name], use_threads=False).aggregate([([], "count_all")]).rename_columns(["group", name, f"n_{name}"]) if big else t

    single = one[group]
    plain = pa.table({"group": group[single], "a": ids[single], "b": other_ids[one[other_group]]})
    few = side(group, ids, "a", False).join(side(other_group, other_ids, "b", False), "group", join_type="inner", use_threads=False)
    few = pa.concat_tables([plain, few.select(["group", "a", "b"])])
    few = few.append_column("n", pa.array(np.ones(len(few), np.int64)))
    if not large.any():
        return few
    many = side(group, ids, "a", True).join(side(other_group, other_ids, "b", True), "group", join_type="inner", use_threads=False)
    return pa.concat_tables([few, many.select(["group", "a", "b"]).append_column("n", pc.multiply(many["n_a"], many["n_b"]))])


def _text(x: str) -> pa.Scalar:
    return pa.scalar(x, pa.large_string())


def _listed(side: Side, ids: pa.Array, group: np.ndarray, n: int) -> pa.Array:
    """The decimal ids of each group, with commas."""
    off = np.searchsorted(group, np.arange(n + 1))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(off, pa.int64()), side.decimal.take(ids)), _text(","))


class Aligner:
    def __init__(self, a: ByteEncoder, b: PieceEncoder):
        self.a, self.b = Side(a), Side(b)
        self.width = len(self.b.sizes)

    def align(self, texts: list[str]) -> dict[str, np.ndarray | pa.Array]:
        """Per text: n_a, n_b, n_groups, n_links, sha; and the links as (doc, pair, n) in order of doc, pair being a * width + b."""
        whole = [(" " + t).encode() if t else b"" for t in texts]
        a_ids, a_doc, a_end, a_ok = self.a.tokens(self.a.encoder.encode([" " + t if t else "" for t in texts]), whole)
        b_ids, b_doc, b_end, b_ok = self.b.tokens(self.b.encoder.encode(texts), whole)
        ok, n = a_ok & b_ok, len(texts)
        if not ok.all():
            a_keep, b_keep = ok[a_doc], ok[b_doc]
            a_ids, a_doc, a_end = a_ids.filter(pa.array(a_keep)), a_doc[a_keep], a_end[a_keep]
            b_ids, b_doc, b_end = b_ids.filter(pa.array(b_keep)), b_doc[b_keep], b_end[b_keep]
        out = {"n_a": np.bincount(a_doc, minlength=n), "n_b": np.bincount(b_doc, minlength=n)}
        if not len(a_ids):
            none = np.zeros(0, np.int64)
            return out | {"n_groups": np.zeros(n, np.int64), "n_links": np.zeros(n, np.int64), "sha": pa.array([""] * n), "doc": none, "pair": none, "n": none}
        begin = np.concatenate([[0], np.cumsum([len(w) for w in whole])])
        a_key, b_key = begin[a_doc] + a_end, begin[b_doc] + b_end  # document and end in one: the place in the batch
        key = np.sort(pa.table({"end": a_key}).join(pa.table({"end": b_key}), "end", join_type="inner", use_threads=False)["end"].to_numpy())
        cut_doc = np.searchsorted(begin[1:], key)
        a_group, b_group = np.searchsorted(key, a_key), np.searchsorted(key, b_key)
        links = _links(a_group, a_ids.to_numpy(), b_group, b_ids.to_numpy())
        pairs = pa.table({"doc": cut_doc[links["group"].to_numpy()], "pair": pc.add(pc.multiply(links["a"], self.width), links["b"]), "n": links["n"]})
        counted = pairs.group_by(["doc", "pair"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["doc", "pair", "n"])
        doc = counted["doc"].to_numpy()
        order = np.argsort(doc, kind="stable")
        doc, pair, number = doc[order], counted["pair"].to_numpy()[order], counted["n"].to_numpy()[order]
        groups = np.bincount(cut_doc, minlength=n)
        each = pc.binary_join_element_wise(_listed(self.a, a_ids, a_group, len(key)), _listed(self.b, b_ids, b_group, len(key)), _text("|"))
        lists = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(groups)]), pa.int64()), each), _text(";")).cast(pa.large_binary())
        sha = [hashlib.sha256(x.as_buffer()).hexdigest() if g else "" for x, g in zip(lists, groups.tolist(), strict=True)]
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, doc, number)
        return out | {"n_groups": groups, "n_links": n_links, "sha": pa.array(sha), "doc": doc, "pair": pair, "n": number}


class PairCounts:
    """Documents per pair, over what a task has seen since it last gave them on."""

    def __init__(self):
        self.held: list[pa.Table] = []
        self.rows = 0

    def add(self, pair: np.ndarray) -> Iterator[pa.Table]:
        t = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "docs"])
        self.held.append(t)
        self.rows += len(t)
        if self.rows > HELD_PAIRS:
            now = self._merged()
            self.held, self.rows = [now], len(now)
            if self.rows > HELD_PAIRS // 2:
                yield from self.rest()

    def _merged(self) -> pa.Table:
        return pa.concat_tables(self.held).group_by("pair", use_threads=False).aggregate([("docs", "sum")]).rename_columns(["pair", "docs"])

    def rest(self) -> Iterator[pa.Table]:
        if self.rows:
            yield self._merged()
        self.held, self.rows = [], 0


def aligned(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """A row for each document (its numbers and its distinct pairs, with the number of links of each) and rows of pairs with a task's document counts (row is null)."""
    schema = _DOC.format(docs.schema["doc_id"].dataType.simpleString()) + ", pairs array<int>, numbers array<int>"

    def lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, counts = Aligner(ByteEncoder(byte_file, special=False), PieceEncoder(piece_file)), PairCounts()
        row, id_of = TaskContext.get().partitionId() << 33, None

        def partial(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for s in range(0, len(t), 50_000):
                x = t.slice(s, 50_000)
                off = np.array([0, len(x)])
                none = [pa.nulls(1, id_of), *(pa.nulls(1, pa.int64()) for _ in range(5)), pa.nulls(1, pa.string())]
                yield pa.RecordBatch.from_arrays([*none, lists(x["pair"].to_numpy(), off), lists(x["docs"].to_numpy(), off)], names=names)

        names = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "numbers"]
        for b in batches:
            id_of = b.schema.field("doc_id").type
            for i, texts in text_slices(b.column("_text")):
                r = aligner.align(texts)
                off = np.searchsorted(r["doc"], np.arange(len(texts) + 1))
                numbers = [pa.array(np.arange(row, row + len(texts))), *(pa.array(r[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")), r["sha"]]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, len(texts)), *numbers, lists(r["pair"], off), lists(r["n"], off)], names=names)
                row += len(texts)
                for t in counts.add(r["pair"]):
                    yield from partial(t)
        for t in counts.rest():
            yield from partial(t)

    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, schema)


def pair_counts(made: DataFrame, width: int) -> DataFrame:
    """pair, docs and best (whether no pair of the same first id has more documents), over all rows of aligned()."""
    counts = made.where("row IS NULL").select(F.explode(F.arrays_zip("pairs", "numbers")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.numbers").alias("docs"))
    return counts.withColumn("a", F.expr(f"pair div {width}"))


def _head_limit(counts: DataFrame) -> int:
    """The least power of two of documents that at most HEAD_PAIRS pairs reach."""
    seen = counts.groupBy(F.floor(F.log2("docs")).cast("int").alias("k")).count().collect()  # at most 63 rows; no count of documents reaches 2**62
    n, limit = 0, 62
    for r in sorted(seen, key=lambda r: -r.k):
        if (n := n + r["count"]) > HEAD_PAIRS:
            break
        limit = r.k
    return 1 << limit


def align_documents(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs (doc_id, text).

    Texts that are null, empty or not given back by both tokenizers' bytes have zeros and an empty digest. Repeated rows
    count as documents of their own; other columns are left out; an empty table gives an empty one. One text's tokens
    and links are held in one task. The tokenizers' files must be readable on the executors.
    """
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=piece_file).get_piece_size()
    made = cut(aligned(docs, byte_file, piece_file), "aligned")
    counts = cut(pair_counts(made, width), "pairs")
    highest = counts.groupBy("a").agg(F.max("docs").alias("most"))  # at most one row for each id of the first vocabulary
    counts = counts.join(F.broadcast(highest), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    limit = _head_limit(counts)
    head = counts.where(F.col("docs") >= limit).toPandas().sort_values("pair")  # at most HEAD_PAIRS rows
    told = docs.sparkSession.sparkContext.broadcast((head.pair.to_numpy(np.int64), head.docs.to_numpy(np.int64), head.best.to_numpy(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n_docs, best = told.value
        for b in batches:
            lists = b.column("pairs")
            doc, pair, n = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy(), pc.list_flatten(b.column("numbers")).to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            found = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            total, most = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            if found.any():
                np.add.at(total, doc[found], n[found] * n_docs[at[found]])
                np.add.at(most, doc[found], n[found] * best[at[found]])
            left = ~found
            off = np.searchsorted(doc[left], np.arange(len(b) + 1))
            rest = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x[left], pa.int32())) for x in (pair, n)]
            kept = [b.column(c) for c in b.schema.names if c not in ("pairs", "numbers")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total), pa.array(most), *rest], names=[*(c for c in b.schema.names if c not in ("pairs", "numbers")), "count_sum", "n_best", "pairs", "numbers"])

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields if f.name not in ("pairs", "numbers"))
    summed = cut(made.where("row IS NOT NULL").mapInArrow(run, f"{plain}, count_sum long, n_best long, pairs array<int>, numbers array<int>"), "summed")
    discard(made)
    rest = summed.where("size(pairs) > 0").select("row", F.explode(F.arrays_zip("pairs", "numbers")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.numbers").alias("n"))
    tail = counts.where(F.col("docs") < limit)
    more = rest.join(tail, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("docs")).alias("_sum"), F.sum(F.col("n") * F.col("best").cast("long")).alias("_best"))
    both = summed.drop("pairs", "numbers").join(more, "row", "left")
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
