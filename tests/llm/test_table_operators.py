"""Embedding near-duplicates, WARC archives and connected components against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

VEC = "vec_id long, embedding array<float>, label int"


def brute_links(rows, threshold):
    ok = lambda v, l: l is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)  # noqa: E731, E741
    n = [0] * len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, u, la) in enumerate(rows):
        for b in range(a):
            v, lb = rows[b][1:]
            if ok(u, la) and ok(v, lb) and la == lb and len(u) == len(v):
                x, y = np.float32(u).astype(float), np.float32(v).astype(float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    n[a] += 1
                    n[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, n[k], least[find(k)], i == least[find(k)]) for k, (i, _, _) in enumerate(rows))


def test_near_embeddings_equal_brute_force(spark, monkeypatch):
    from tessera.llm import near_embed

    monkeypatch.setattr(near_embed, "BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 30)):
            rows.append((len(rows), (centre + rng.normal(size=16) * rng.choice([0.02, 0.08, 0.3])).astype(np.float32).tolist(), int(c % 3)))
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, rows[3][1], None), (905, rows[3][1], rows[3][2]), (906, [None] + [1.0] * 15, 0), (907, [1.0, 2.0], 0), (908, [2.0, 4.0], 0), (909, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, VEC).withColumnRenamed("vec_id", "vec_id").selectExpr("*", "1 AS rep", "2 AS key", "3 AS weight")
    got = sorted(tuple(r) for r in near_embed.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect())
    want = brute_links(rows, 0.98)
    recall = sum(min(a[1], b[1]) for a, b in zip(got, want, strict=True)) / sum(b[1] for b in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True)) and recall > 0.99
    assert [a for a in got if a[0] >= 900] == [b for b in want if b[0] >= 900]
    assert near_embed.expected_recall(0.98, 20, 8, 1.0) > 0.99
    assert near_embed.near_duplicates(spark.createDataFrame([], VEC)).count() == 0


def test_repeated_vector_ids_are_separate_rows(spark):
    from tessera.llm.near_embed import near_duplicates

    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 0)]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, VEC)).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_repeated_ids_on_different_vectors_labels_and_nulls(spark):
    from tessera.llm.near_embed import near_duplicates

    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.001, 0.0], 0), (3, [0.0, 1.0, 0.001], 0), (4, [0.0, 0.0, 1.0], 0)]
    rows += [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 2), (6, [1.0, 0.01], 1), (None, [1.0, 0.0], 1), (7, [1.0, 0.0], None), (5, None, 1), (5, [1.0, 0.0], 1)]
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, VEC)).collect()), key=str)
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 2, 5, True), (5, 2, 5, True), (5, 0, 5, True), (6, 2, 5, False), (None, 0, None, True), (7, 0, 7, True), (5, 0, 5, True)]
    assert got == sorted(want, key=str)


def test_double_precision_decides_at_the_threshold(spark):
    from tessera.llm.near_embed import near_duplicates

    near = lambda c: [(1, [1.0, 0.0], "a"), (2, [c, (1 - c * c) ** 0.5], "a")]
    schema = "vec_id long, embedding array<double>, label string"
    assert {r.n_links for r in near_duplicates(spark.createDataFrame(near(0.98 + 1e-9), schema), tables=60).collect()} == {1}
    assert {r.n_links for r in near_duplicates(spark.createDataFrame(near(0.98 - 1e-9), schema), tables=60).collect()} == {0}


PAGE = "page_id long, url string, html string"


@pytest.mark.parametrize("broadcast", [100_000, 1])
def test_archives_read_back_as_written(spark, broadcast, monkeypatch):
    from tessera.llm import warc
    from tessera.llm.warc import archive_pages

    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", broadcast)  # beyond it the bit filter

    rng = random.Random(2)
    big = ["é" * rng.randint(500, 900) + str(k) for k in range(5)]
    rows = [(k, f"http://x/{k}", rng.choice(big)) for k in range(40)]
    rows += [(100, None, None), (101, "u\r\nX: y", ""), (102, "u", "short"), (103, "u", "short"), (104, "u", "a" * 999), (105, "u", "a" * 999), (106, "u", "b" * 1000), (107, "u", "b" * 1000), (108, "u", "WARC/1.1\r\n\r\n" * 20_000), (None, "u", "b" * 1000)]
    df = spark.createDataFrame(rows, PAGE).selectExpr("*", "1 AS payload", "2 AS payload_digest", "3 AS refers_to")
    got = {r.page_id: r for r in archive_pages(df).collect()}
    assert len(got) == len(rows)
    largest = {}
    for i, _, h in rows:
        if h is not None and len(h.encode()) >= 1000 and i is not None:
            largest[h] = max(largest.get(h, i), i)
    for i, _, h in rows:
        body = (h or "").encode()
        owner = largest.get(h)
        assert got[i].payload_bytes == len(body) and got[i].payload_digest == hashlib.sha1(body).hexdigest()
        if i is not None:
            assert (got[i].record_type, got[i].refers_to) == (("revisit", owner) if owner not in (None, i) else ("response", None))
    assert got[None].record_type == "revisit" and got[None].refers_to == 107
    assert archive_pages(spark.createDataFrame([], PAGE)).count() == 0


def test_archive_members_are_standard_gzip_records():
    import gzip

    from tessera.llm.warc import parse, record

    data = record(1, "http://a", b"x" * 10, "d", None, False) + record(1, "http://b", b"x" * 10, "d", "http://a", True) + record(None, None, b"", "d", None, False)
    text = gzip.decompress(data)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.count(b"WARC-Refers-To-Target-URI: http://a\r\n") == 1
    heads = list(parse(data))
    assert len({h["WARC-Record-ID"] for h, _ in heads}) == 3
    assert [(h["WARC-Type"], b.partition(b"\r\n\r\n")[2]) for h, b in heads] == [("response", b"x" * 10), ("revisit", b""), ("response", b"")]
    with pytest.raises(ValueError, match="not a WARC record"):
        list(parse(gzip.compress(b"junk\r\n")))


def test_a_revisit_without_its_original_is_an_error(spark, tmp_path):
    from tessera.llm.warc import read_archives, record

    (tmp_path / "a.warc.gz").write_bytes(record(1, "u", b"x", "0" * 40, "v", True))
    archives = spark.createDataFrame([("a.warc.gz",)], "archive string")
    with pytest.raises(Exception, match="no original has the payload"):
        read_archives(f"file://{tmp_path}", archives).collect()


def test_components_of_long_paths_and_stars(spark):
    from tessera.llm.scratch import connected_components

    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(1000, 1080)] + [(rng.randrange(2000, 2060), rng.randrange(2000, 2060)) for _ in range(50)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert collections.Counter(got.values())[5] == 81
