"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti and Kaushik, 2006), exact at a fixed threshold of 0.8.

Sets are put into size bands; two sets with Jaccard 0.8 or more lie in one band or in neighbours and differ in at most
k = (|r| + |s|) / 9 elements. For each band the feature domain is divided by hash into more partitions than that bound,
and subsets of partitions are enumerated as signatures. Up to k = 3 there is one level: all subsets of n - k of the n
partitions. Above it there are two: k differences leave some group of n2 partitions with n2 - 1 at most, so the subsets of
one partition in each group are enumerated; of all the method's parameters this choice gives the fewest signatures, whose
shuffle is the largest of the join. Sets that share a signature are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.kernel import distinct_sorted, mix64, shingles, slices, words_of
from tessera.llm.scratch import bit_filter, connected_components, may_hold
from tessera.scratch import cut, discard, shuffle_parts

#: A signature that more sets than this share gives no pairs; sets that lean on such signatures are compared in groups.
PAIRS_UP_TO = 24
#: Sets and bytes of text on one side of a block comparison, and sets that one group compares with its hubs.
BLOCK, BLOCK_BYTES, FAN = 512, 2 << 20, 256
#: Bytes of text for each bucket of signatures at most, so that a bucket doesn't grow with the corpus.
BUCKET_BYTES = 16 << 20
#: Sets of each dense group with which all its members are compared first.
HUBS = 4
#: Signatures and set ids that a task remembers, to send each common one and each repeated set once only; forgetting them costs time.
REMEMBERED = 200_000
OWN, UPPER, PREFIX = 0, 1, 2
DOC, SIGNATURE, COMMON = 0, 1, 2
_SALT = np.uint64(0xA24BAED4963EE407)
_MARK = np.int64(-(2**63))  # stands for a set in the row that tells that a signature is common


def bands(largest: int) -> np.ndarray:
    """Upper ends of the size bands, each 25/16 times as wide as where it starts, up to one band beyond ``largest``.

    A partner is at most 5/4 times as large, so only the upper half of a band needs the signatures of the next one too.
    """
    out, low = [], 1
    while not out or out[-1] <= 2 * largest + 8:
        out.append(max(low, low * 25 // 16))
        low = out[-1] + 1
    return np.array(out, np.int64)


def set_signatures(doc: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set number, signature, need * 4 + kind) for the sets given by sorted distinct (doc, value) pairs.

    need: how many non-empty signatures of this kind a set shares at least with any similar one. Where that is none
    (too many empty partitions), the set also gives the shingles of its prefix, which similar sets must share too.
    """
    top = bands(int(sizes.max(initial=1)))
    band = np.searchsorted(top, np.maximum(sizes, 1))
    unsafe = np.zeros(len(sizes), bool)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for kind in (OWN, UPPER):
        at = band + kind
        r = top[at]
        use = sizes > 0
        if kind == UPPER:
            use &= 5 * sizes >= 4 * (top[band] + 1)
        k = 2 * r // 9
        few = (k >= 1) & (k <= 3)
        parts = np.where(k == 0, 1, np.where(few, k + 2, np.maximum(k + 1, -(-r // 4) + 2)))
        parts = np.where(use, parts, 0)
        first = np.concatenate([[0], np.cumsum(parts)])
        mine = use[doc]
        d = doc[mine]
        spread = mix64(value[mine] ^ _SALT)
        cell = first[d] + ((spread >> np.uint64(20)) % np.maximum(parts[d], 1).astype(np.uint64)).astype(np.int64)
        sums = np.zeros(first[-1], np.uint64)
        np.add.at(sums, cell, spread)
        filled = np.bincount(cell, minlength=first[-1])
        owner = np.repeat(np.arange(len(sizes)), parts)
        place = (np.arange(first[-1]) - first[owner]).astype(np.uint64)
        coded = mix64(sums + mix64(place + (at[owner].astype(np.uint64) << np.uint64(32))))
        empty = np.bincount(owner[filled == 0], minlength=len(sizes))
        bound = (sizes + np.minimum(r, 5 * sizes // 4)) // 9
        need = np.where(few, (empty < 2).astype(np.int64), parts - bound - empty)
        unsafe |= use & (need < 1)
        note = np.maximum(need, 0) * 4 + kind
        single = (filled > 0) & ~few[owner]
        out.append((owner[single], coded[single], note[owner[single]]))
        for n in (1, 2, 3):
            rows = np.flatnonzero(use & (k == n))
            for a, b in combinations(range(n + 2), 2):
                x, y = first[rows] + a, first[rows] + b
                some = (filled[x] + filled[y]) > 0
                joint = mix64(coded[x] * np.uint64(3) + coded[y] * np.uint64(7))
                out.append((rows[some], joint[some], note[rows[some]]))
    if unsafe.any():
        ends = np.concatenate([[0], np.cumsum(sizes)])
        prefix = sizes - (4 * sizes + 4) // 5 + 1
        head = unsafe[doc] & (np.arange(len(doc)) - ends[doc] < prefix[doc])
        out.append((doc[head], mix64(value[head] ^ np.uint64(0x5851F42D4C957F2D)), np.full(head.sum(), 4 + PREFIX)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _set_ids(doc: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; equal sets have equal ids."""
    sums = np.zeros(len(sizes), np.uint64)
    np.add.at(sums, doc, mix64(value))
    return mix64(sums + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, doc, value, sizes, set ids) for each slice of the texts."""
    for i, _, raw, off in slices(texts):
        d, v = distinct_sorted(*shingles(words_of(raw, off)))
        sizes = np.bincount(d, minlength=len(off) - 1)
        yield i, d, v, sizes, _set_ids(d, v, sizes)


def _size_code(sizes: np.ndarray) -> np.ndarray:
    """One byte for a size; codes of sizes within a factor of 5/4 differ by 4 at most."""
    return np.minimum(np.log(np.maximum(sizes, 1)) / np.log(1.06), 255).astype(np.uint8)


def _need_code(need: np.ndarray) -> np.ndarray:
    """One byte for a need; exact up to 127, rounded down above, which keeps more pairs and never loses one."""
    return np.where(need < 128, need, np.minimum(128 + (need - 128) // 16, 255)).astype(np.uint8)


def _need(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.int64)
    return np.where(code < 128, code, 128 + (code - 128) * 16)


_PACKED = "bucket int, what int, ids binary, meta binary, keys binary"


def _packed(bucket: int, what: int, ids: np.ndarray, meta: bytes, keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([what], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), meta, keys.tobytes()))], ["bucket", "what", "ids", "meta", "keys"])


def _pack(owner: np.ndarray, sig: np.ndarray, note: np.ndarray, ids: np.ndarray, sizes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row for each bucket: the sets that have signatures there (id, codes of size and needs, counts by kind) and 6 bytes of each signature."""
    bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    kind = note % 4
    run = ((bucket * len(ids) + owner) << 2) | kind
    order = np.argsort(run, kind="stable")
    run, bucket, kind = run[order], bucket[order], kind[order]
    new = np.concatenate([[True], run[1:] != run[:-1]])
    at = np.flatnonzero(new)
    rank = np.arange(len(run)) - at[np.cumsum(new) - 1]  # a count has one byte, so runs of more than 255 are split
    if rank.max() >= 255:
        again = np.lexsort((kind, rank // 255, run >> 2))
        order, run, bucket, kind, rank = order[again], run[again], bucket[again], kind[again], rank[again]
    new = np.concatenate([[True], (run[1:] >> 2 != run[:-1] >> 2) | (rank[1:] // 255 != rank[:-1] // 255)])
    at = np.flatnonzero(new)
    who = (run[at] >> 2) % len(ids)
    needs = np.zeros((2, len(ids)), np.int64)
    for k in (OWN, UPPER):
        some = note % 4 == k
        needs[k, owner[some]] = note[some] // 4
    meta = np.stack([_size_code(sizes)[who], _need_code(needs[0])[who], _need_code(needs[1])[who], *(np.add.reduceat(kind == k, at, dtype=np.int64).astype(np.uint8) for k in (OWN, UPPER, PREFIX))], 1)
    keys = np.ascontiguousarray(sig[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    runs = np.concatenate([np.searchsorted(at, first), [len(at)]])
    ends = np.concatenate([first, [len(bucket)]])

    def column(data: np.ndarray, bounds: np.ndarray, width: int) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])

    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(np.full(len(first), SIGNATURE, np.int32)), column(ids[who], runs, 8), column(meta, runs, 6), column(keys, ends, 6)], ["bucket", "what", "ids", "meta", "keys"])


def _named(sig: np.ndarray, buckets: int) -> np.ndarray:
    """What stands for a signature after the shuffle: 48 of its bits behind its bucket's number."""
    bucket = (sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return ((bucket & np.uint64(0x7FFF)) << np.uint64(48) | sig & np.uint64((1 << 48) - 1)).view(np.int64)


def _emit(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed rows: the documents of each slice (dealt evenly) and the signatures of its sets, by bucket.

    A signature that more than PAIRS_UP_TO sets of one slice share is common. From then on the task sends its sets
    under that signature as settled, dealt evenly, and only a mark to the signature's bucket, so that no bucket gets a
    row for each of very many sets.
    """
    done: set[int] = set()
    common = np.zeros(0, np.uint64)
    serial = 0
    for batch in batches:
        for i, d, v, sizes, ids in _sets(batch.column("text")):
            serial += 1
            docs = batch.column("doc_id").slice(i, len(sizes))
            told = batch.column("told").slice(i, len(sizes)).to_numpy()
            meta = docs.fill_null(0).to_numpy().tobytes() + sizes.astype("<u4").tobytes() + docs.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
            yield _packed(serial % buckets, DOC, ids, meta, told)
            _, once = np.unique(ids, return_index=True)
            fresh = np.zeros(len(ids), bool)
            fresh[once] = True
            fresh &= np.array([x not in done for x in ids.tolist()], bool) & (sizes > 0)
            if len(done) > REMEMBERED:
                done.clear()
            done.update(ids[fresh].tolist())
            mine = fresh[d]
            o, s, n = set_signatures(d[mine], v[mine], np.where(fresh, sizes, 0))
            if not len(o):
                continue
            names, place, count = np.unique(s, return_inverse=True, return_counts=True)
            new = names[(count > PAIRS_UP_TO) & ~np.isin(names, common)]
            if len(new):
                common = np.union1d(common[: REMEMBERED // 2], new)
                yield _pack(np.zeros(len(new), np.int64), new, np.full(len(new), 4 + PREFIX), np.array([_MARK]), np.ones(1, np.int64), buckets)
            settled = np.isin(names, common)[place]
            if settled.any():
                yield _packed(serial % buckets, COMMON, ids[o[settled]], n[settled].astype("<u4").tobytes(), _named(s[settled], buckets))
                o, s, n = o[~settled], s[~settled], n[~settled]
            if len(o):
                yield _pack(o, s, n, ids, sizes, buckets)


def _bytes(column: pa.Array) -> np.ndarray:
    off = np.frombuffer(column.buffers()[1], np.int32, count=len(column) + 1, offset=4 * column.offset)
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]


def _signatures(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name of the signature, set id, note << 8 | size code) of each signature of the packed rows."""
    ids, meta, keys = _bytes(rows.column("ids")).view(np.int64), _bytes(rows.column("meta")).reshape(-1, 6), _bytes(rows.column("keys")).reshape(-1, 6)
    per = np.diff(np.frombuffer(rows.column("ids").buffers()[1], np.int32, count=rows.num_rows + 1, offset=4 * rows.column("ids").offset)) // 8
    bucket = np.repeat(rows.column("bucket").to_numpy().astype(np.int64), per)
    counts = meta[:, 3:].astype(np.int64)
    notes = np.stack([_need(meta[:, 1]) * 4 + OWN, _need(meta[:, 2]) * 4 + UPPER, np.full(len(meta), 4 + PREFIX)], 1)
    each = counts.sum(1)
    wide = np.zeros((len(keys), 8), np.uint8)
    wide[:, :6] = keys
    return wide.view("<i8").ravel() | np.repeat((bucket & 0x7FFF) << 48, each), np.repeat(ids, each), np.repeat((notes << 8 | meta[:, :1]).ravel(), counts.ravel())


#: what 0: document b (t: hash of its text) has set a of n shingles; 1: sets a and b share n signatures, their notes are x and y; 2: set b has the common signature a, its note is n.
_FOUND = "what int, a long, b long, n int, x int, y int, t long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads packed rows sorted by bucket: passes documents on, turns signatures of few sets into pairs and names the members of common ones.

    A bucket's signatures are sorted at once: buckets are sized by the bytes of the texts, and common signatures come as marks.
    """

    def rows(what: int, a: np.ndarray, b: pa.Array, n: np.ndarray, x: np.ndarray | None = None, y: np.ndarray | None = None, t: np.ndarray | None = None) -> pa.RecordBatch:
        more = [pa.nulls(len(a), pa.int32()) if c is None else pa.array(c.astype(np.int32)) for c in (x, y)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), what, np.int32)), pa.array(a), b, pa.array(n.astype(np.int32)), *more, pa.nulls(len(a), pa.int64()) if t is None else pa.array(t)], ["what", "a", "b", "n", "x", "y", "t"])

    def settle(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ident, n = (np.concatenate(c) for c in zip(*map(_signatures, parts), strict=True))
        order = np.lexsort((ident, key))
        key, ident, n = key[order], ident[order], n[order]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])
        # Most signatures have one set only.
        alone = np.zeros(len(key), bool)
        alone[1:-1] = (key[1:-1] != key[:-2]) & (key[1:-1] != key[2:])
        keep &= ~alone
        key, ident, n = key[keep], ident[keep], n[keep]
        if not len(key):
            return
        note, size = n >> 8, n & 255
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(key)]]))
        often = (counts > PAIRS_UP_TO) | (ident[starts] == _MARK)
        named = np.repeat(often, counts) & (ident != _MARK)
        if named.any():
            yield rows(COMMON, key[named], pa.array(ident[named]), note[named])
        pairs: list[np.ndarray] = []
        for m in np.unique(counts[~often & (counts > 1)]):
            at = starts[~often & (counts == m)]
            i, j = np.triu_indices(m, 1)  # ids ascend inside a key
            i, j = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            alike = np.abs(size[i] - size[j]) <= 4
            i, j = i[alike], j[alike]
            pairs.append(np.stack([ident[i], ident[j], note[i] << 32 | note[j]], 1))
        p = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
        if len(p):
            p = p[np.lexsort(p.T)]
            at = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]).any(1)]))
            shared = np.diff(np.concatenate([at, [len(p)]]))
            p = p[at]
            yield rows(SIGNATURE, p[:, 0], pa.array(p[:, 1]), shared, p[:, 2] >> 32, p[:, 2] & 0xFFFFFFFF)

    held: list[pa.RecordBatch] = []
    now: int | None = None
    for batch in batches:
        what = batch.column("what").to_numpy()
        for kind in (DOC, COMMON):
            for ids, meta, keys in zip(*(batch.filter(pa.array(what == kind)).column(c).to_pylist() for c in ("ids", "meta", "keys")), strict=True):
                ids, keys = np.frombuffer(ids, np.int64), np.frombuffer(keys, np.int64)
                m = len(ids)
                if kind == DOC:
                    doc = pa.array(np.frombuffer(meta, np.int64, m), mask=np.frombuffer(meta, np.uint8, m, 12 * m).astype(bool))
                    yield rows(DOC, ids, doc, np.frombuffer(meta, "<u4", m, 8 * m), t=keys)
                else:
                    yield rows(COMMON, keys, pa.array(ids), np.frombuffer(meta, "<u4"))
        some = batch.filter(pa.array(what == SIGNATURE))
        bucket = some.column("bucket").to_numpy()
        cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        for s, e in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
            if s == e:
                continue
            if held and bucket[s] != now:
                yield from settle(held)
                held = []
            now = bucket[s]
            held.append(some.slice(s, e - s))
    if held:
        yield from settle(held)


def _roots(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = names.copy()
    while True:
        was = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (was == root).all():
            return root


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets on the left with those on the right, by products of 0/1 blocks."""
    values = [np.concatenate(left), np.concatenate(right)]
    shared = np.intersect1d(values[0], values[1])
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(shared), 4096):
        part = shared[lo : lo + 4096]
        sides = []
        for v, o, x in zip(values, owner, (left, right), strict=True):
            at = np.searchsorted(part, v)
            hit = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == v)
            m = np.zeros((len(x), len(part)), np.float32)
            m[o[hit], at[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


_GROUP = ["level", "g", "left_block", "right_block"]


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the left and right sets of each group as (a, b) rows that join the same sets as all links would.

    A group's left sets come first and are held; they are few (hubs) or bounded in number and bytes (a block). The right
    ones stream. Where both blocks are one, the left sets are compared among themselves.
    """
    left: list[tuple[int, np.ndarray]] = []
    now: tuple | None = None

    def solve(right: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not left or not right:
            return
        both = _overlaps([x for _, x in left], [x for _, x in right])
        one, two = (np.array([len(x) for _, x in side]) for side in (left, right))
        i, j = np.nonzero(100 * both >= 80 * (one[:, None] + two[None, :] - both))
        ids, place = np.unique([*(k for k, _ in left), *(k for k, _ in right)], return_inverse=True)
        root = _roots(ids, place[i], place[len(left) + j])
        some = root != ids
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(root[some])], ["a", "b"])

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in _GROUP], 1)
        right, ids = batch.column("right").to_numpy(zero_copy_only=False), batch.column("id").to_numpy()
        for i, _, v, sizes, _ in _sets(batch.column("text")):
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = np.arange(i, i + len(sizes))
            cuts = np.flatnonzero((keys[at[1:]] != keys[at[:-1]]).any(1) | (right[at[1:]] != right[at[:-1]])) + 1
            for s, e in zip([0, *cuts], [*cuts, len(at)], strict=True):
                group = tuple(keys[i + s].tolist())
                if group != now:
                    if now is not None and now[0] == 2 and now[2] == now[3]:
                        yield from solve(left)
                    left, now = [], group
                part = [(int(ids[i + k]), v[ends[k] : ends[k + 1]].copy()) for k in range(s, e)]
                if right[i + s]:
                    yield from solve(part)
                else:
                    left += part
    if now is not None and now[0] == 2 and now[2] == now[3]:
        yield from solve(left)


def _wanted(docs: DataFrame, members: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of one document of each set in ids: documents are read again, chosen by a bit filter of fixed size over doc_id."""
    some = members.join(ids, "id", "left_semi").groupBy("id").agg(F.min("doc").alias("doc"))
    told = bit_filter(some.select(F.xxhash64("doc").alias("h")), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array(np.flatnonzero(may_hold(told, batch.column("h").to_numpy())))
            texts = batch.column("text").take(rows)
            for i, _, _, sizes, names in _sets(texts):
                _, once = np.unique(names, return_index=True)
                once = once[sizes[once] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(names[once]), texts.take(pa.array(i + once))], ["id", "text"])

    made = docs.select(F.xxhash64("doc").alias("h"), "text").mapInArrow(run, "id long, text string")
    return cut(made.join(ids, "id", "left_semi").dropDuplicates(["id"]), "sets")


def _parts(total: Column, most: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / F.lit(most))).cast("int")


def _rows(df: DataFrame, level: int, g: str, left_block: Column, right_block: Column, right: bool, ident: str) -> DataFrame:
    return df.select(F.lit(level).alias("level"), F.col(g).alias("g"), left_block.cast("int").alias("left_block"), right_block.cast("int").alias("right_block"), F.lit(right).alias("right"), F.col(ident).alias("id"))


def _stars(pairs: DataFrame) -> DataFrame:
    """Group rows that compare the b sets of pairs with their a sets; an a of very many b has several groups."""
    fan = pairs.groupBy("a").agg(_parts(F.count(F.lit(1)), FAN).alias("c"))
    left = fan.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    right = pairs.join(fan, "a").withColumn("s", F.pmod(F.xxhash64("b"), F.col("c")))
    return _rows(left, 0, "a", F.col("s"), F.lit(0), False, "a").unionByName(_rows(right, 0, "a", F.col("s"), F.lit(0), True, "b"))


def _hubs(placed: DataFrame) -> DataFrame:
    """Group rows that compare all sets of a dense group with HUBS of them."""
    hubs = F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64(F.lit(k), "id"), "id"))["id"] for k in range(HUBS)]))
    groups = placed.groupBy("dense").agg(_parts(F.count(F.lit(1)), FAN).alias("c"), hubs.alias("hubs"))
    left = groups.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).withColumn("hub", F.explode("hubs"))
    right = placed.join(groups.drop("hubs"), "dense").withColumn("s", F.pmod(F.xxhash64("id"), F.col("c")))
    return _rows(left, 1, "dense", F.col("s"), F.lit(0), False, "hub").unionByName(_rows(right, 1, "dense", F.col("s"), F.lit(0), True, "id"))


def _blocks(placed: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Group rows that compare sets of a dense group which hubs haven't joined yet.

    Sets of one component fill blocks of their own where it is large, others share blocks; two blocks of one component
    aren't compared.
    """
    known = placed.join(comps, "id", "left").select("id", "dense", F.coalesce("component", "id").alias("comp"))
    apart = cut(known.groupBy("dense").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("dense"), "apart")
    if apart.isEmpty():
        return None
    known = cut(known.join(apart, "dense", "left_semi").join(sets.select("id", F.octet_length("text").cast("long").alias("bytes")), "id"), "apart")
    load = F.greatest(F.sum("bytes") / F.lit(BLOCK_BYTES), F.count(F.lit(1)) / F.lit(BLOCK))
    large = known.groupBy("dense", "comp").agg(load.alias("load")).where("load >= 0.5").select("dense", "comp", F.lit(True).alias("_large"))
    owned = cut(known.join(large, ["dense", "comp"], "left").select("id", "dense", "bytes", F.when(F.col("_large"), F.col("comp")).alias("own")), "owned")
    counts = owned.groupBy("dense", "own").agg(F.greatest(F.lit(1), F.ceil(load)).cast("int").alias("c"))
    base = cut(counts.withColumn("base", F.expr("coalesce(sum(c) OVER (PARTITION BY dense ORDER BY own ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").cast("int")), "base")
    member = owned.join(base, (owned["dense"] == base["dense"]) & owned["own"].eqNullSafe(base["own"])).select("id", owned["dense"], (F.col("base") + F.pmod(F.xxhash64("id"), F.col("c"))).cast("int").alias("block"))
    block = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).select("dense", "own", (F.col("base") + F.col("k")).alias("block"))
    one, two = block.select("dense", F.col("own").alias("x"), F.col("block").alias("i")), block.select("dense", F.col("own").alias("y"), F.col("block").alias("j"))
    met = cut(one.join(two, "dense").where("i <= j AND coalesce(x <> y, true)").select("dense", "i", "j"), "met")
    left = member.join(met, (member["dense"] == met["dense"]) & (F.col("block") == F.col("i"))).select(member["dense"], "i", "j", "id")
    right = member.join(met, (member["dense"] == met["dense"]) & (F.col("block") == F.col("j"))).where("i < j").select(member["dense"], "i", "j", "id")
    out = cut(_rows(left, 2, "dense", F.col("i"), F.col("j"), False, "id").unionByName(_rows(right, 2, "dense", F.col("i"), F.col("j"), True, "id")), "blocks")
    discard(apart, known, owned, base, met)
    return out


def _linked(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of the groups, each set's text shuffled once for each group that it is in."""
    dealt = groups.join(sets, "id").select(*_GROUP, "right", "id", "text").repartition(shuffle_parts(groups.sparkSession), *_GROUP).sortWithinPartitions(*_GROUP, "right")
    return cut(dealt.mapInArrow(_check, "a long, b long"), "links")


def _classes(docs: DataFrame) -> DataFrame:
    """(doc, t, n, id, comp) for each row of docs (doc_id, text): the text's hash, its set's size and id, the set's component."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_parts(spark), -(-size // BUCKET_BYTES))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    signed = plain.select(F.col("doc").alias("doc_id"), "text", F.xxhash64("text").alias("told")).mapInArrow(lambda b: _emit(b, buckets), _PACKED)
    met = cut(signed.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, _FOUND), "met")
    members = met.where(F.col("what") == DOC).select(F.col("a").alias("id"), F.col("b").alias("doc"), "n", "t")

    kind, need = (lambda c: F.col(c) % 4), (lambda c: F.floor(F.col(c) / 4))
    common = met.where(F.col("what") == COMMON).select(F.col("a").alias("sig"), F.col("b").alias("id"), kind("n").alias("kind"), need("n").alias("need")).distinct()
    heat = cut(common.groupBy("id", "kind").agg(F.count(F.lit(1)).alias("hot"), F.max("need").alias("need")), "heat")
    leaning = heat.where("hot >= need").select("id", "kind")
    edges = cut(common.join(leaning, ["id", "kind"], "left_semi").select("sig", "id"), "leaning")
    low = edges.groupBy("sig").agg(F.min("id").alias("low"))
    linked = connected_components(edges.join(low, "sig").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct())
    placed = linked.withColumnRenamed("component", "dense")

    # A similar pair shares at least as many signatures as either set needs, less those of the set that are common.
    met_pairs = met.where(F.col("what") == SIGNATURE).groupBy("a", "b", "x", "y").agg(F.sum("n").alias("n"))
    for side, note in (("a", "x"), ("b", "y")):
        hot = heat.select(F.col("id").alias(side), F.col("kind").alias("_kind"), F.col("hot").alias(f"hot_{side}"))
        met_pairs = met_pairs.withColumn("_kind", kind(note)).join(hot, [side, "_kind"], "left").drop("_kind")
    least = F.greatest(need("x") - F.coalesce("hot_a", F.lit(0)), need("y") - F.coalesce("hot_b", F.lit(0)))
    pairs = cut(met_pairs.where(F.col("n") >= least).select("a", "b").distinct(), "pairs")
    ids = cut(reduce(DataFrame.unionByName, [pairs.select(F.col("a").alias("id")), pairs.select(F.col("b").alias("id")), placed.select("id")]).distinct(), "ids")
    sets = _wanted(plain, members, ids)
    discard(heat, edges, ids)

    # Only reachability is asked for: each set is compared with one partner or with hubs first, then only what these leave apart.
    links = _linked(_stars(pairs.groupBy("b").agg(F.min("a").alias("a"))).unionByName(_hubs(placed)), sets)
    comps = connected_components(links)
    discard(links)
    still = pairs
    for side in ("a", "b"):
        still = still.join(comps.select(F.col("id").alias(side), F.col("component").alias(f"comp_{side}")), side, "left")
    rest = cut(still.where("coalesce(comp_a, a) <> coalesce(comp_b, b)").select("a", "b"), "pairs")
    blocks = _blocks(placed, comps, sets)
    if blocks is not None or not rest.isEmpty():
        links = _linked(_stars(rest) if blocks is None else _stars(rest).unionByName(blocks), sets)
        comps, first = connected_components(comps.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links)), comps
        discard(links, first)
    owned = cut(members.join(comps, "id", "left").select("doc", "t", "n", "id", F.coalesce("component", "id").alias("comp")), "owned")
    discard(met, linked, pairs, rest, sets, comps, *([] if blocks is None else [blocks]))
    return owned


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text).

    A set holds the distinct five-word shingles of the whole text, or the whole word sequence where it is shorter; sets
    link when 100 * intersection >= 80 * union. A text without words (null, empty) has an empty set, linked with
    nothing. Equal sets are one, so copies cost one row each and are never paired. component_id is the smallest doc_id
    that links reach; repeated rows get equal results; a null doc_id stands in no component's minimum but its own.
    Shingles and sets are told apart by 64-bit hashes.

    A signature that at most PAIRS_UP_TO sets share gives candidate pairs, counted before the shuffle; pairs that share
    fewer signatures than similar sets must are dropped. One that more share gives none; a set for
    which fewer than ``need`` signatures are left could lose a partner that way, so all such sets which common
    signatures connect form a dense group: its members are compared with a few of them, then those that are still apart
    in blocks by sparse products. Either way no link between components is lost, and there is no row for each pair of a
    large group.
    """
    owned = _classes(docs)
    least = cut(owned.where("n > 0").groupBy("comp").agg(F.min("doc").alias("least")), "least")
    return owned.join(least, "comp", "left").select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id; columns of docs.

    Null doc_ids come last; ties go to the smaller hash of the text, then of the row. So repeated rows leave one, and a
    doc_id that stands on different texts is decided for each text. Texts without words all stay.
    """
    names = docs.columns
    each = cut(_classes(docs).where("n > 0").groupBy("comp", "doc", "t").agg(F.count(F.lit(1)).alias("rows")), "each")
    first = F.struct(F.col("doc").isNull().alias("last"), "doc", "t", "rows")
    kept = cut(each.groupBy("comp").agg(F.min(first).alias("k")).select("k.doc", "k.t", "k.rows"), "kept")
    gone = cut(each.select("doc", "t").subtract(kept.select("doc", "t")).select(F.col("doc").alias("_one_doc"), F.col("t").alias("_one_text")), "gone")
    # Rows that the filter doesn't name stay where they lie; only the others, few beside those that go, are joined.
    told = bit_filter(gone.select(F.xxhash64("_one_doc", "_one_text").alias("h")), "h")
    hit = F.arrow_udf(lambda h: pa.array(may_hold(told, h.to_numpy())), T.BooleanType())
    row = F.struct(*[F.col(f"`{c}`") for c in names])  # rows travel whole, so no column of theirs can clash with one of these
    marked = docs.select(row.alias("_row"), F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_t")).withColumn("_may", hit(F.xxhash64("_d", "_t")))
    same = [F.col("_d").eqNullSafe(F.col("_one_doc")), F.col("_t") == F.col("_one_text")]
    left = marked.where("NOT _may").unionByName(marked.where("_may").join(gone, same, "left_anti")).drop("_may")
    many = kept.where("rows > 1").select(F.col("doc").alias("_one_doc"), F.col("t").alias("_one_text"))
    if many.isEmpty():
        return left.select("_row.*")
    keyed = left.join(many, same, "left_semi").withColumn("_h", F.xxhash64(*[F.col("_row").getField(c) for c, kind in docs.dtypes if "map<" not in kind]))
    one = keyed.groupBy("_d", "_t").agg(F.min_by("_row", "_h").alias("_row"))
    return left.join(many, same, "left_anti").select("_row").unionByName(one.select("_row")).select("_row.*")
