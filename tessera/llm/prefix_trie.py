"""The trie of conversation prefixes: what conversations share from their first turn on.

Conversations are sequences of turn keys (16 bytes each). Spark sorts them; a shard, a block of consecutive sorted
conversations, is a trie of its own, written as balanced parentheses. A tree of minima and maxima of the excess over
blocks of parentheses finds closing and enclosing ones, ranks of ``()`` count leaves and cumulative sums over the
preorder give savings, all for every node of the shard at once. A node that several shards share lies on the path to a
shard's first or last conversation; these spines, a few rows per shard, are merged in the order of the shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import cut, shuffle_parts

#: Turns from which a task closes a shard; about 200 bytes each are held.
SHARD_TURNS = 500_000
#: Parentheses of one leaf of the excess tree.
BLOCK = 64
#: Ids of one piece of text that goes into a digest.
PIECE_IDS = 50_000
KEY = 16
WORDS = r"[^\x20\x09-\x0D]+"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SHARD = f"kind int, {NODE}, key binary, parent_key binary, shard long, at long, is_leaf long, words long, ids string"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


class Excess:
    """Excess of a sequence of parentheses, with the least and largest of each block and of all powers of two of blocks."""

    def __init__(self, excess: np.ndarray):
        n = -(-len(excess) // BLOCK)
        self.blocks = np.concatenate([excess, np.full(n * BLOCK - len(excess), excess[-1], excess.dtype)]).reshape(n, BLOCK)
        self.low, self.high = [self.blocks.min(1)], [self.blocks.max(1)]
        while len(self.low[-1]) > 1:
            odd = len(self.low[-1]) % 2
            self.low.append(np.append(self.low[-1], self.low[-1][-odd:][:odd]).reshape(-1, 2).min(1))
            self.high.append(np.append(self.high[-1], self.high[-1][-odd:][:odd]).reshape(-1, 2).max(1))

    def _in_block(self, block: np.ndarray, value: np.ndarray, after: np.ndarray | None) -> np.ndarray:
        """First place of the value in the block (behind ``after``), or -1."""
        out = np.empty(len(block), np.int64)
        for i in range(0, len(block), 16384):
            hit = self.blocks[block[i : i + 16384]] == value[i : i + 16384, None]
            if after is not None:
                hit &= np.arange(BLOCK) > after[i : i + 16384, None]
            out[i : i + 16384] = np.where(hit.any(1), hit.argmax(1), -1)
        return out

    def next(self, start: np.ndarray, value: np.ndarray) -> np.ndarray:
        """First place behind each start whose excess is the value, which must exist. Steps of one make every block between its extremes hold all values between."""
        block = start // BLOCK
        found = self._in_block(block, value, start % BLOCK)
        out = block * BLOCK + found
        left = np.flatnonzero(found < 0)
        node = block[left]
        for level, (low, high) in enumerate(zip(self.low, self.high, strict=True)):
            if not len(left):
                break
            beside = np.minimum(node + 1, len(low) - 1)
            hit = (node % 2 == 0) & (node + 1 < len(low)) & (low[beside] <= value[left]) & (value[left] <= high[beside])
            who, at = left[hit], beside[hit]
            for k in range(level - 1, -1, -1):
                at = 2 * at
                at += ~((self.low[k][at] <= value[who]) & (value[who] <= self.high[k][at]))
            out[who] = at * BLOCK + self._in_block(at, value[who], None)
            left, node = left[~hit], node[~hit] // 2
        return out


@dataclass
class Trie:
    """A shard's nodes in preorder, the root first."""

    depth: np.ndarray
    parent: np.ndarray
    first: np.ndarray  # conversations from first
    last: np.ndarray  # to before last are below the node
    words: np.ndarray
    conv_id: np.ndarray
    n_children: np.ndarray
    n_leaves: np.ndarray
    saved: np.ndarray
    end: np.ndarray  # the node where each conversation ends


def shard_trie(conv_id: np.ndarray, keys: np.ndarray, length: np.ndarray, words: np.ndarray) -> Trie:
    """The trie of sorted conversations: keys and words of all their turns one after the other, length turns each."""
    n, off = len(length), np.concatenate([[0], np.cumsum(length)])
    conv = np.repeat(np.arange(n), length)
    step = np.arange(off[-1]) - off[conv]
    before = np.where(conv > 0, off[conv - 1] + step, 0)
    same = (conv > 0) & (step < length[conv - 1]) & (keys[np.minimum(before, max(off[-1] - 1, 0))] == keys).all(1)
    shared = np.zeros(n, np.int64)  # turns in common with the conversation before
    some = np.flatnonzero(length)
    if len(some):
        shared[some] = np.minimum(np.minimum.reduceat(np.where(same, np.iinfo(np.int64).max, step), off[:-1][some]), length[some])
    opens, closes = length - shared, np.concatenate([[0], length[:-1]]) - shared
    runs = np.concatenate([[0, 1], np.stack([closes, opens], 1).ravel(), [length[-1] + 1, 0]])
    bits = np.repeat(np.arange(len(runs)) % 2 == 1, runs)
    of = np.repeat(np.concatenate([[0, 0], np.repeat(np.arange(n), 2), [n, n]]), runs)
    excess = np.cumsum(np.where(bits, 1, -1), dtype=np.int64)
    at = np.flatnonzero(bits)
    close = Excess(excess).next(at, excess[at] - 1)
    backward = Excess(np.append(excess[::-1], 0))  # place i stands at len(excess) - 1 - i, the start before all at len(excess)
    rank = np.cumsum(bits)
    parent = np.full(len(at), -1, np.int64)
    inner = at[1:]
    parent[1:] = rank[len(excess) - backward.next(len(excess) - 1 - inner, excess[inner] - 2)] - 1
    leaf = bits & ~np.append(bits[1:], False)
    leaves = np.concatenate([[0], np.cumsum(leaf)])
    new = np.flatnonzero(step >= shared[conv])
    node_words = np.concatenate([[0], words[new]]).astype(np.int64)
    first, last = of[at], of[close]
    saved = np.concatenate([[0], np.cumsum((last - first - 1) * node_words)])
    size = (close - at + 1) // 2
    least = np.minimum.reduceat(np.append(conv_id, np.iinfo(np.int64).max), np.stack([first, last], 1).ravel())[::2]
    k = np.arange(len(at))
    return Trie(excess[at] - 1, parent, first, last, node_words, least, np.bincount(parent[1:], minlength=len(at)), leaves[close] - leaves[at], saved[k + size] - saved[k], np.cumsum(opens))


def _prefix_keys(path: np.ndarray) -> list[bytes]:
    """A key for each prefix of a path of turn keys, the empty one first."""
    h = hashlib.md5(usedforsecurity=False)
    out = [h.digest()]
    for key in path:
        h.update(key.tobytes())
        out.append(h.copy().digest())
    return out


def _shard_rows(shard: int, conv_id: np.ndarray, keys: np.ndarray, length: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whole nodes (kind 0), those of the shard's spines (1) and the ids of conversations that end on spines (2)."""
    t = shard_trie(conv_id, keys, length, words)
    n, nodes = len(length), len(t.depth)
    spine = np.zeros(nodes, bool)
    spine[: length[0] + 1] = True  # the path to the first conversation
    to_last = np.flatnonzero(t.last == n)
    spine[to_last] = True
    key: dict[int, bytes] = dict(enumerate(_prefix_keys(keys[: length[0]])))
    key |= zip(to_last.tolist(), _prefix_keys(keys[len(keys) - length[-1] :]), strict=True)
    begins = np.flatnonzero(np.concatenate([[True], t.end[1:] != t.end[:-1]]))
    ends = dict(zip(t.end[begins].tolist(), zip(begins.tolist(), [*begins[1:].tolist(), n], strict=True), strict=True))
    listed = {k: ",".join(map(str, conv_id[i:j].tolist())) for k, (i, j) in ends.items() if not spine[k]}
    digest = [hashlib.sha256(listed[k].encode()).hexdigest() if k in listed else _NO_ENDS for k in range(nodes)]
    own_parent = np.where(t.parent >= 0, t.conv_id[t.parent], 0)
    above = np.where(t.parent >= 0, spine[t.parent], True)
    names = [c.rsplit(" ", 1)[0] for c in _SHARD.split(", ")]

    def batch(kind: int, n: int, **cols) -> pa.RecordBatch:
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        full = {"kind": pa.array(np.full(n, kind, np.int32)), "shard": pa.array(np.full(n, shard, np.int64))} | cols
        return pa.RecordBatch.from_arrays([full[c] if c in full else pa.nulls(n, types[d]) for c, d in (x.rsplit(" ", 1) for x in _SHARD.split(", "))], names=names)

    def node_columns(rows: np.ndarray) -> dict[str, pa.Array]:
        parents = t.parent[rows].tolist()
        return {
            "conv_id": pa.array(t.conv_id[rows]), "depth": pa.array(t.depth[rows]), "n_convs": pa.array(t.last[rows] - t.first[rows]), "n_children": pa.array(t.n_children[rows]),
            "n_leaves": pa.array(t.n_leaves[rows]), "saved_tokens": pa.array(t.saved[rows]), "parent_key": pa.array([key.get(p) for p in parents], pa.binary()),
        }

    for i in range(0, nodes, 50_000):
        rows = np.flatnonzero(~spine[i : i + 50_000]) + i
        if len(rows):
            yield batch(0, len(rows), **node_columns(rows), parent_conv_id=pa.array(own_parent[rows], mask=above[rows]), ends_sha256=pa.array([digest[r] for r in rows.tolist()]))
    rows = np.flatnonzero(spine)
    leaf = (t.n_children[rows] == 0).astype(np.int64)
    yield batch(1, len(rows), **node_columns(rows), key=pa.array([key[r] for r in rows.tolist()], pa.binary()), at=pa.array(np.arange(len(rows))), is_leaf=pa.array(leaf), words=pa.array(t.words[rows]))
    for r in rows.tolist():
        if r in ends:
            i, j = ends[r]
            for a in range(i, j, PIECE_IDS):
                yield batch(2, 1, key=pa.array([key[r]], pa.binary()), at=pa.array([a]), ids=pa.array([",".join(map(str, conv_id[a : min(a + PIECE_IDS, j)].tolist()))]))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, held, turns, shard = TaskContext.get().partitionId(), [], 0, 0
    for b in batches:
        held.append(b)
        turns += len(b.column("words").flatten()) + len(b)
        if turns >= SHARD_TURNS:
            yield from _shard_rows(part << 32 | shard, *_arrays(held))
            held, turns, shard = [], 0, shard + 1
    if sum(map(len, held)):
        yield from _shard_rows(part << 32 | shard, *_arrays(held))


def _arrays(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    t = pa.Table.from_batches(batches)
    path, words = t.column("path").combine_chunks().cast(pa.large_binary()), t.column("words").combine_chunks()
    ends = np.frombuffer(path.buffers()[1], np.int64, count=len(path) + 1, offset=8 * path.offset)
    data = np.frombuffer(path.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] else np.zeros(0, np.uint8)
    return t.column("conv_id").to_numpy(), data.reshape(-1, KEY).view(np.uint64), np.diff(ends) // KEY, words.flatten().to_numpy().astype(np.int64)


@dataclass
class _Open:
    """A node of the spines while shards still add to it."""

    row: dict
    copies: int = 1
    twice: int = 0  # children counted by more than one shard
    leaves: int = 0  # corrections of the leaves and savings below
    saved: int = 0
    closed: dict = field(default_factory=dict)


def _merge_spines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per node of the spines, in whose subtrees every shared node counts once. Rows come in the order of shards and preorder; a stack of one path is held."""
    stack: list[_Open] = []
    done: list[dict] = []
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens", "is_leaf")

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            r = node.row
            r["n_children"] -= node.twice
            node.leaves += (r["n_children"] == 0) - r["is_leaf"]
            node.saved += (node.copies - 1) * r["words"]
            r["n_leaves"] += node.leaves
            r["saved_tokens"] += node.saved
            if stack:
                stack[-1].leaves += node.leaves
                stack[-1].saved += node.saved
                stack[-1].twice += node.copies - 1
            done.append({c: r[c] for c in ("key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")})

    def out() -> pa.RecordBatch:
        ints = [c for c in done[0] if c not in ("key", "parent_key")]
        rows = pa.RecordBatch.from_pylist(done, schema=pa.schema([("key", pa.binary()), ("parent_key", pa.binary()), *((c, pa.int64()) for c in ints)]))
        done.clear()
        return rows

    for b in batches:
        for r in b.to_pylist():
            d = r["depth"]
            if len(stack) > d and stack[d].row["key"] == r["key"]:
                held = stack[d].row
                for c in sums:
                    held[c] += r[c]
                held["conv_id"] = min(held["conv_id"], r["conv_id"])
                stack[d].copies += 1
            else:
                close(d)
                stack.append(_Open(r))
        if len(done) > 10_000:
            yield out()
    close(0)
    if done:
        yield out()


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest per key over its pieces of text, comma between them; rows come sorted, one digest's state is held."""
    now, h = None, hashlib.sha256()
    for b in batches:
        keys, digests = [], []
        for key, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if key == now:
                h.update(b",")
            else:
                if now is not None:
                    keys.append(now)
                    digests.append(h.hexdigest())
                now, h = key, hashlib.sha256()
            h.update(ids.encode())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests)], names=["key", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], names=["key", "ends"])


def turn_rows(turns: DataFrame) -> DataFrame:
    """conv_id and t (turn, key, words) for each turn of a conversation; key is 16 bytes, in hex, for its role and text, null ones empty."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), key.alias("key"), F.regexp_count(text, F.lit(WORDS)).alias("words")).alias("t"))


def _paths(lists: DataFrame) -> DataFrame:
    """conv_id, path (keys of all turns one after the other) and words per turn, of conversations with a list ``turns``."""
    return lists.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: x["key"]), "")).alias("path"), F.transform("turns", lambda x: x["words"].cast("int")).alias("words"))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, path and words of each conversation as it stands, in order of turn (null first)."""
    return _paths(turn_rows(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))


def rebuilt_conversations(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """conv_id, path and words of conversations whose first h turns are those of conversation c - c % group; h is the CRC-32 of the decimal id modulo ``most``.

    One shuffle of turn keys brings the ``group`` conversations of a base together.
    """
    base = F.expr(f"conv_id - conv_id % {group}L")
    lists = turn_rows(turns).withColumn("base", base).repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, most))).over(Window.partitionBy("base"))  # at most `group` rows in each
    h = F.expr(f"int(crc32(cast(conv_id AS string)) % {most})")
    mixed = lists.withColumn("head", head).withColumn("h", h).withColumn("turns", F.expr("concat(CASE WHEN head IS NULL THEN slice(turns, 1, 0) ELSE slice(head, 1, h) END, slice(turns, h + 1, greatest(size(turns) - h, 0)))"))
    return _paths(mixed)


def prefix_nodes(convs: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the conversations (conv_id, path, words): NODE.

    A node is named by its smallest member and its depth: it stands for that conversation's first ``depth`` turns. A
    conversation's keys (20 bytes a turn) are held in one task. Digests of conversations that end at one node are taken
    in order of conv_id in one pass over their ids, by one task where a node's ids lie in several shards: the digest's
    definition leaves no other way, and only ids go there, packed.
    """
    rows = cut(convs, "paths")
    made = cut(rows.repartitionByRange(shuffle_parts(rows.sparkSession), "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_shards, _SHARD), "shards")
    parts = made.where("kind = 1").select("shard", "at", "key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "is_leaf", "words")
    merged = parts.repartition(1).sortWithinPartitions("shard", "at").mapInArrow(_merge_spines, "key binary, parent_key binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    spine = cut(merged, "spines")  # at most two paths for each shard
    ends = made.where("kind = 2").select("key", "shard", "at", "ids").repartition("key").sortWithinPartitions("key", "shard", "at").mapInArrow(_digest_ends, "key binary, ends string")
    above = spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    names = [c.split(" ")[0] for c in NODE.split(", ")]
    shared = spine.join(above, "parent_key", "left").join(ends, "key", "left").withColumn("parent_conv_id", F.col("above")).withColumn("ends_sha256", F.coalesce("ends", F.lit(_NO_ENDS))).select(names)
    inner = made.where("kind = 0 AND parent_key IS NULL").select(names)
    below = made.where("kind = 0 AND parent_key IS NOT NULL").join(above, "parent_key").withColumn("parent_conv_id", F.col("above")).select(names)
    return inner.unionByName(below).unionByName(shared)


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations of turns (conv_id, turn, role, text).

    Turns that tie in ``turn`` are taken in order of the MD5 of their role and text; repeated rows are turns of their own;
    rows without conv_id belong to no conversation and other columns are left out. An empty table has no node, not even
    a root.
    """
    return prefix_nodes(rebuilt_conversations(turns))
