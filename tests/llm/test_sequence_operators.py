"""Packing, tokenizer alignment and the conversation trie against brute-force versions."""

import bisect
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"
EOT = "<|endoftext|>"


def texts(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéüßжд日本🙂'") for _ in range(rng.randint(1, 8))) for _ in range(150)]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 30, 100, 300, 900, 2500]))) for _ in range(n)]
    out += [None, "", " ", "\n", "  \n\t x  ", EOT, f"a{EOT} b{EOT}", "it's  we'll\r\n", "▁a ▁▁ b", "x\x00y", "a\x1c!\x1c b  c  ", "z" * 5000, " " * 30_000 + "end", out[3], out[3], "ﬁ Å é ½"]
    return out


def docs(spark, values):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(values)] + [(None, "without id"), (3, values[3])], DOCS)
    return df.withColumn("part", F.lit("x")).withColumn("k", F.lit(1)).withColumn("length", F.lit(None).cast("int")).withColumn("_text", F.lit("y"))


# --- op13


def brute_best_fit(lengths, capacity):
    """What item-by-item best-fit decreasing leaves in its windows: their sums, which don't depend on the choice among equal windows."""
    windows = []
    for n in sorted(lengths, reverse=True):
        fits = [w for w in windows if capacity - sum(w) >= n]
        if fits:
            min(fits, key=lambda w: capacity - sum(w)).append(n)
        else:
            windows.append([n])
    return sorted(map(sum, windows))


@pytest.mark.parametrize("capacity", [1, 7, 64, 100])
def test_plan_is_best_fit_decreasing(capacity):
    from tessera.llm.packing import best_fit

    rng = random.Random(capacity)
    for trial in range(20):
        lengths = [rng.randint(1, capacity) if trial % 2 else 1 + int(rng.random() ** 3 * (capacity - 1)) for _ in range(rng.choice([0, 1, 5, 200]))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        rows = best_fit(counts, capacity)
        windows = {}
        for n, c in counts.items():
            own = rows[rows[:, 0] == n]
            for rank in range(c):
                _, first, window, each, used = own[np.searchsorted(own[:, 1], rank, "right") - 1]
                windows.setdefault(int(window + (rank - first) // each), []).append((int(used + (rank - first) % each * n), n))
        assert sorted(windows) == list(range(len(windows)))
        for held in windows.values():
            held.sort()
            assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= capacity
        assert sorted(sum(n for _, n in w) for w in windows.values()) == brute_best_fit(lengths, capacity)


def test_plan_stays_small():
    from tessera.llm.packing import best_fit

    assert len(best_fit({n: 10**9 + n * 7919 for n in range(1, 1025)})) < 140_000


def test_packed_documents_hold_the_librarys_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm.packing import pack_documents, packed_sequences

    file = public_tokenizers.path("byte_bpe_50k.json")
    lib, values = Tokenizer.from_file(file), texts()
    df = docs(spark, values).repartition(3)
    got = pack_documents(df, file).toPandas()
    want = [(i, lib.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in [*enumerate(values), (None, "without id"), (3, values[3])]]
    expected = sorted((-1 if i is None else i, s, len(x[s : s + 1024]), zlib.crc32(np.array(x[s : s + 1024], "<u4").tobytes()), len(x)) for i, x in want for s in range(0, len(x), 1024))
    assert sorted(got.fillna({"doc_id": -1}).astype({"doc_id": int})[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False, name=None)) == expected
    used = got.groupby("sequence_id").length.sum()
    assert sorted(used.index) == list(range(len(used))) and used.max() <= 1024
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    assert len(used) == len(brute_best_fit(list(got.length), 1024))
    by_id = {i: np.array(x, "<u4") for i, x in want if i is not None}
    for r in packed_sequences(df, file).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.n_tokens == sum(p.length for p in r.pieces)
        for p in r.pieces:
            if p.doc_id is not None:
                assert (ids[p.offset : p.offset + p.length] == by_id[p.doc_id][p.start : p.start + p.length]).all()
    assert pack_documents(spark.createDataFrame([], DOCS), file).count() == 0


def test_faster_library_gives_the_same_ids():
    import public_tokenizers

    from tessera.llm.tokens import ByteEncoder

    rng = random.Random(5)
    strings = [t or "" for t in texts(9)] + ["".join(chr(rng.choice([32, 10, 39, 97, 48, 233, 0x4E2D, 0x1F600, 0x200B, 0xA0, 9, 33])) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for special in (False, True):
        e = ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"), special)
        assert e.fast is not None
        assert [list(x) for x in e.encode(strings)] == [x.ids for x in e.lib.encode_batch(strings, add_special_tokens=False)]
    words = ByteEncoder(public_tokenizers.path("word_bpe_49k.json"), False)
    assert words.fast is None and [list(x) for x in words.encode(["One two"])] == [words.lib.encode("One two", add_special_tokens=False).ids]


# --- op12

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    """All nodes of the rebuilt conversations, by sets of prefixes."""
    key = lambda r, t: hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    own = {}
    for c, n, r, t in rows:
        if c is not None:
            own.setdefault(c, []).append((n is not None, n or 0, key(r or "", t or ""), r or "", t or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    saved = {p: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p, m in members.items()}
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below), len(leaves), sum(saved[q] for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def turns(seed):
    rng = random.Random(seed)
    said = ["", "a", "b b", "c  c\tc", "d " * 40, None]
    rows = []
    for c in rng.sample(range(400), 150):
        depth = rng.choice([1, 1, 2, 3, 4, 6, 9])
        rows += [(c, n, rng.choice(["user", "user", None]), rng.choice(said[: rng.choice([1, 3, 6])])) for n in range(depth)]
    rows += [(c, n, "user", "same") for c in range(1000, 1100) for n in range(3)]  # a large group of copies
    rows += [(c, n, "user", f"long {n}") for c in (2000, 2001, 2023) for n in range(150)]
    rows += [(20, None, "user", "null turn"), (20, None, "user", "null turn"), (None, 0, "user", "no conversation"), (7, 0, "user", "tie"), (7, 0, "user", "tie b"), (3005, 1, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [1, 40, 500_000])
def test_trie_equals_brute_force(spark, monkeypatch, shard_turns):
    from tessera.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard_turns)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = turns(shard_turns)
        df = spark.createDataFrame(rows, TURNS).withColumn("key", F.lit("x")).withColumn("base", F.lit(1)).withColumn("words", F.lit(2)).withColumn("h", F.lit(0)).withColumn("t", F.lit("t"))
        got = sorted((tuple(r) for r in prefix_trie.conversation_trie(df.repartition(3)).collect()), key=lambda r: r[:2])
        assert got == brute_trie(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trie_of_plain_conversations_and_of_none(spark):
    from tessera.llm.prefix_trie import conversation_trie, conversations, prefix_nodes

    df = spark.createDataFrame([(21, 0, "u", "x"), (22, 0, "u", "x"), (22, 1, "a", "y")], TURNS)
    got = {(r.conv_id, r.depth): (r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in prefix_nodes(conversations(df)).collect()}
    assert got == {(21, 0): (2, 1, 1, 1), (21, 1): (2, 1, 1, 1), (22, 2): (1, 0, 1, 0)}
    assert conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "u", "x")], TURNS)).count() == 0


def test_excess_finds_the_next_place_of_a_value():
    from tessera.llm import prefix_trie

    rng = np.random.default_rng(4)
    for n in (2, 63, 64, 65, 5000):
        e = np.cumsum(rng.choice([-1, 1], n))
        tree = prefix_trie.Excess(e)
        start = rng.integers(0, n, 300)
        value = e[rng.integers(0, n, 300)]
        ok = [(s, v, s + 1 + int(np.argmax(e[s + 1 :] == v))) for s, v in zip(start, value, strict=True) if (e[s + 1 :] == v).any()]
        if ok:
            s, v, want = map(np.array, zip(*ok, strict=True))
            assert (tree.next(s, v) == want).all()


# --- op11


def brute_alignment(rows):
    """Every document token by token, with the libraries themselves."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = {}
    spare = 256
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255:
            letters[chr(x)] = x
        else:
            letters[chr(spare)], spare = x, spare + 1
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, count = [], collections.Counter()
    for i, t in rows:
        whole = (" " + t).encode() if t else b""
        x = [(k, bytes(letters[c] for c in a.id_to_token(k))) for k in a.encode(" " + t, add_special_tokens=False).ids] if t else []
        y = [(k, piece(k)) for k in b.encode(t)] if t else []
        if b"".join(v for _, v in x) != whole or b"".join(v for _, v in y) != whole:
            x = y = []
        ends = [set(itertools.accumulate(len(v) for _, v in z)) for z in (x, y)]
        common = sorted(ends[0] & ends[1])
        groups = [([], []) for _ in common]
        for side, z in enumerate((x, y)):
            at = 0
            for k, v in z:
                at += len(v)
                groups[bisect.bisect_left(common, at)][side].append(k)
        links = collections.Counter((p, q) for g in groups for p in g[0] for q in g[1])
        count.update(links.keys())
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        docs.append((i, len(x), len(y), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    most = collections.Counter()
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    return sorted(((-1 if i is None else i, na, nb, ng, sum(ln.values()), sum(n for pq, n in ln.items() if count[pq] == most[pq[0]]), sum(n * count[pq] for pq, n in ln.items()), sha) for i, na, nb, ng, ln, sha in docs), key=str)


@pytest.mark.parametrize(("head", "held", "large"), [(1_000_000, 1_000_000, 4096), (40, 30, 2), (0, 500, 4096)])
def test_alignment_equals_brute_force(spark, monkeypatch, head, held, large):
    import public_tokenizers

    from tessera.llm import alignment

    for name, value in (("HEAD_PAIRS", head), ("HELD_PAIRS", held), ("LARGE_GROUP", large)):
        monkeypatch.setattr(alignment, name, value)
    values = texts(3, 25) + ["日本語の文章です。" * 30, "naïve café — “quoted” text…", " odd spaces", "a" * 700 + "🙂" * 50]
    df = docs(spark, values).withColumn("row", F.lit("x")).withColumn("pairs", F.lit(1)).withColumn("pair", F.lit(1)).withColumn("n", F.lit(2)).withColumn("docs", F.lit(2))
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    got = alignment.align_documents(df.repartition(3), *files)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == columns
    assert sorted((tuple(-1 if v is None else v for v in r) for r in got.collect()), key=str) == brute_alignment([*enumerate(values), (None, "without id"), (3, values[3])])
    assert alignment.align_documents(spark.createDataFrame([], DOCS), *files).count() == 0


# --- one document of each group


def test_one_of_each_with_clashing_columns_and_repeated_rows(spark):
    from tessera.llm.partenum import one_of_each

    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, near), (1, near), (2, near + " more"), (3, "another text of several words here"), (3, "another text of several words here"), (4, None), (None, near)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("_one_doc", "_one_text", "_row", "_d", "_t", "_h", "_may", "h", "comp"):
        df = df.withColumn(c, F.lit("x"))
    out = one_of_each(df)
    assert out.columns == df.columns and sorted((r.doc_id, r.text) for r in out.collect()) == [(1, near), (3, rows[3][1]), (4, None)]
    assert one_of_each(df.where("false")).count() == 0
