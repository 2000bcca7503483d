"""Word boundaries and 64-bit word hashes of whole Arrow batches of texts, in numpy.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes after A-Z are lower-cased. A word's hash is a polynomial over
a random table, taken from prefix sums modulo 2**64, so a batch needs no Python loop over words. Memory is about 40
bytes for each byte of a slice; a slice holds whole texts and, beyond one text, at most SLICE bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit integers that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, SLICE + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


@dataclass
class Words:
    """Words of some texts: data (lower-cased bytes), start and end of each word, its text's number and its hash; counts and first word per text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    count: np.ndarray
    first: np.ndarray
    size: np.ndarray  # bytes of each text
    raw: np.ndarray  # bytes before lower-casing
    bounds: np.ndarray  # offsets of the texts in data


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive slices; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    arr = texts.cast(pa.large_binary()).fill_null(b"") if texts.null_count else texts.cast(pa.large_binary())
    if not len(arr):
        return
    off = np.frombuffer(arr.buffers()[1], np.int64, count=len(arr) + 1, offset=8 * arr.offset)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None and arr.buffers()[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words_of(raw: np.ndarray, off: np.ndarray) -> Words:
    n, docs = len(raw), len(off) - 1
    data = _LOWER[raw]
    word = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, word[:-1]
        after[-1], after[:-1] = False, word[1:]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[:n], out=sums[1:])
    hashes = mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    doc = np.searchsorted(off[1:], start, "right")
    count = np.bincount(doc, minlength=docs).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    return Words(data, start, end, doc, hashes, count, first, np.diff(off), raw, off)


_STEP = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(1, 2**62, 64)]


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit id) of every k-word shingle, repeats included; a text of fewer words gives its whole sequence as one."""
    total = len(w.hash)
    sizes = np.minimum(w.count, k)
    per = np.where(w.count > 0, np.maximum(w.count - k + 1, 1), 0)
    doc = np.repeat(np.arange(len(per)), per)
    at = w.first[:-1][doc] + (np.arange(len(doc)) - np.concatenate([[0], np.cumsum(per)])[:-1][doc])
    out = sizes[doc].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(k):
        inside = i < sizes[doc]
        out += np.where(inside, w.hash[np.minimum(at + i, max(total - 1, 0))] * _STEP[i], np.uint64(0)) if total else np.uint64(0)
    return doc, mix64(out)


def distinct_sorted(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (doc, value) pairs in order of doc, then value; doc must be ascending."""
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    d, v = doc[order], value[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return d[keep], v[keep]
