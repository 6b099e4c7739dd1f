"""SimHash and embedding near-dedup against brute force, and their edge cases."""

import numpy as np
import pytest
import xxhash

from meridian.llm import embedding_dedup as E
from meridian.llm import simhash as S
from meridian.llm.common import connected_components

DOCS = "doc_id long, text string"


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_shingles(text, k=3):
    w = [x.lower() for x in (text or "").encode().split()]
    return [b" ".join(w)] if 0 < len(w) < k else [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]


def slow_fingerprint(text, k=3):
    hs = [xxhash.xxh64_intdigest(g, 42) for g in slow_shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / max(1, len(a | b))


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 130)] + [(7, 7), (500, 499)]
    want = components({x for e in links for x in e}, links)
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {n: c for n, c in want.items()}


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("node_rows", [4, 2048])
def test_trie_join_equals_all_pairs(spark, node_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = set(int(x) for x in base)
    for x in base[:20]:  # neighbourhoods, some of them chains beyond the budget
        y = int(x)
        for _ in range(12):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    center = int(base[0])  # one hot neighbourhood
    fps |= {center ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(a)}
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    nodes = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, node long")
    edges = S.near_fingerprints(nodes, 3, node_rows).collect()
    assert all(bin(fps[a] ^ fps[b]).count("1") <= 64 for a, b in edges)
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    assert components(range(len(fps)), [tuple(e) for e in edges]) == components(range(len(fps)), links)


def test_simhash_on_a_table(spark, sf=("/root/testdata/sf0.001")):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()
    fp = {r.doc_id: slow_fingerprint(r.text) for r in docs}
    links = [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 3]
    want = components(fp, links)
    df = spark.createDataFrame([(r.doc_id, r.text) for r in docs], DOCS)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()}
    assert got == {d: (f"{fp[d]:016x}", want[d]) for d in fp}


def test_simhash_edge_cases(spark):
    rows = [(5, None), (3, ""), (9, " \n\t"), (1, "one"), (2, "ONE"), (4, "one two"), (4, "one two"), (None, "one"), (None, "x y z w")]
    got = sorted(map(tuple, S.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert len(got) == len(rows)
    by = {(r[0], r[1]): r[2] for r in got}
    assert by[5, "0" * 16] == by[3, "0" * 16] == by[9, "0" * 16] == 3
    one = f"{slow_fingerprint('one'):016x}"
    assert by[1, one] == by[2, one] == by[None, one] == 1
    assert [r[2] for r in got if r[1] == f"{slow_fingerprint('one two'):016x}"] == [4, 4]
    assert [r[2] for r in got if r[1] == f"{slow_fingerprint('x y z w'):016x}"] == [None]
    assert S.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    long = "abc " * 600_000
    assert S.fingerprint(long.encode()) == slow_fingerprint("abc abc abc")


def test_simhash_links_through_rows_without_id(spark, monkeypatch):
    fake = spark.createDataFrame([(1, 0), (None, 7), (2, 63), (None, -1), (8, 1 << 40)], "id long, fp long")
    monkeypatch.setattr(S, "fingerprints", lambda *a: fake)
    got = S.near_duplicates(spark.createDataFrame([], "doc_id long, text string, component string, fp string")).collect()
    key = lambda r: (r[1], r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(
        [(1, "0" * 16, 1), (None, "0" * 15 + "7", 1), (2, "0" * 14 + "3f", 1), (None, "f" * 16, None), (8, f"{1 << 40:016x}", 1)], key=key)


def test_embeddings_are_dealt_to_cells(spark):
    """The registered query works with several cells on a few thousand vectors."""
    counted, plain = [], E.assign_cells
    def counting(vectors, pivots, *rest):
        counted.append(sum(map(len, pivots.values())))
        return plain(vectors, pivots, *rest)
    E.assign_cells = counting
    try:
        assert E.op2_embedding_dedup(spark, "/root/testdata/sf0.1").count() == 2000
    finally:
        E.assign_cells = plain
    assert counted[0] > 1


def test_similar_documents_equal_all_pairs(spark):
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(0, 4000)}"
    texts = ["", "one", "one two", "ONE two", None]
    for n in (20, 30, 60, 150, 400, 900):
        for _ in range(4):
            base = [word() for _ in range(n)]
            for edits in (0, 1, 1, 2, 3, n // 40, n // 30, n // 20, n // 12):
                t = list(base)
                for at in rng.choice(n, edits, replace=False):
                    t[at] = word()
                texts.append(" ".join(t))
            texts.append(" ".join(base[: n * 9 // 10]))
    hot = [word() for _ in range(50)]
    texts += [" ".join([*hot[:25], word(), *hot[26:]]) for _ in range(120)]
    rows = list(enumerate(texts))
    sets, fp = {i: slow_shingles(t, 5) for i, t in rows}, {i: slow_fingerprint(t, 5) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and (jaccard(sets[a], sets[b]) >= 0.8 or bin(fp[a] ^ fp[b]).count("1") <= 3)]
    got = {r.doc_id: r.component_id for r in S.similar_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == components(range(len(texts)), links)
    assert S.similar_documents(spark.createDataFrame([], DOCS)).count() == 0


def brute_links(vecs, threshold=0.95):
    ok = {i: np.array(v, float) for i, v in vecs if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    return [
        (a, b) for a in ok for b in ok
        if a < b and len(ok[a]) == len(ok[b])
        and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= threshold
    ]


@pytest.mark.parametrize(("block", "cell_rows", "copies"), [(8, 16, 100), (64, 4, 4), (2048, 512, 4)])
def test_embeddings_equal_all_pairs(spark, monkeypatch, block, cell_rows, copies):
    monkeypatch.setattr(E, "MAX_COPIES", copies)
    monkeypatch.setattr(E, "STRIP", 7)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(12):
        c = rng.normal(size=16)
        for _ in range(3 if k else 40):
            rows.append((len(rows), [float(np.float32(x)) for x in c * rng.uniform(0.5, 2) + rng.normal(size=16) * 0.12]))
    rows += [(len(rows) + i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(80)]
    c = rng.normal(size=16)  # one tight group, the core of a cell
    rows += [(len(rows) + i, [float(np.float32(x)) for x in c + rng.normal(size=16) * 0.005]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in E.near_embeddings(df, block=block, cell_rows=cell_rows).collect()}
    links = brute_links(rows)
    want = components([r[0] for r in rows], links)
    degree = {i: sum(i in e for e in links) for i in want}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (degree[i], c, c == i) for i, c in want.items()}


def test_embedding_edge_cases(spark):
    v = [1.0, 0.0, 0.0]
    rows = [(1, v), (2, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0]),
            (8, [float("inf"), 0.0, 0.0]), (9, [1.0, 0.0]), (10, [2.0, 0.0, 0.0]), (None, v)]
    got = E.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
    assert by[1] == [(4, 1)] and by[2] == [(4, 1)] * 2 and by[10] == [(4, 1)] and by[None] == [(4, 1)]
    assert all(by[i] == [(0, i)] for i in (3, 4, 5, 6, 7, 8, 9))
    rows = [(1, [1.0, 0.0], "a"), (None, [1.0, 0.01], "b"), (9, [0.0, 1.0], "c"), (9, [1.0, 0.02], "d"), (None, [-1.0, 0.5], "e"), (None, None, "f")]
    got = E.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string")).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(
        [(1, 2, 1, True), (None, 2, 1, False), (9, 0, 9, True), (9, 2, 1, False), (None, 0, None, True), (None, 0, None, True)], key=key)
    rows = [(1, [1.0, 0.0]), (2, [1e200, 1e199]), (3, [1e-200, 0.0]), (4, [5e-324, 0.0]), (5, [0.0, -1e300])]
    got = E.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 1), (5, 0, 5)]
    assert E.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
