"""LM scoring against a plain recount of the same model."""

import math
import zlib
from collections import Counter

import pytest

from meridian.llm import lm_scoring as L

DOCS = "doc_id long, text string"


def lower(text):
    return [w.decode("utf-8", "surrogateescape") for w in (text or "").encode().lower().split()]


def bucket(c2, c1):
    return 63 + c2.bit_length() if c2 else c1.bit_length()


def recount(rows):
    """Counts by fold and the EM weights, token by token."""
    def crc(i):
        return zlib.crc32(("" if i is None else str(i)).encode())

    fold = [2 if crc(i) % 5 == 1 else crc(i) // 5 % 2 for i, _ in rows]
    toks = [["<b>", "<b>", *lower(t), "<e>"] for _, t in rows]
    uni, bi, tri, ctx = ([Counter(), Counter()] for _ in range(4))
    for f, t in zip(fold, toks):
        if f < 2:
            uni[f].update(t[2:])
            bi[f].update(zip(t, t[1:]))
            tri[f].update(zip(t, t[1:], t[2:]))
            ctx[f].update(t[1:-1])
    n = [sum(u.values()) for u in uni]
    types = len(set(uni[0]) | set(uni[1]))

    def parts(count, n, u, v, w):
        c2, c1 = count(bi, (u, v)), count(ctx, v)
        return bucket(c2, c1), (count(tri, (u, v, w)) / max(1, c2), count(bi, (v, w)) / max(1, c1), count(uni, w) / max(1, n), 1 / (types + 1))

    held = [
        parts(lambda t, k, o=1 - f: t[o][k], n[1 - f], *x) for f, t in zip(fold, toks) if f < 2 for x in zip(t, t[1:], t[2:])
    ]
    weights = {}
    for _ in range(L.EM_ROUNDS):
        acc = {}
        for k, fs in held:
            x = [a * b for a, b in zip(weights.get(k, L.START), fs)]
            s = acc.setdefault(k, [0] * 4)
            for i in range(4):
                s[i] += x[i] / sum(x)
        weights = {k: [max(x, 1e-9 * sum(s)) / sum(s) for x in s] for k, s in acc.items()}
        weights = {k: [x / sum(s) for x in s] for k, s in weights.items()}
    out = []
    for (i, _), f, t in zip(rows, fold, toks):
        base = score = known = 0
        for x in zip(t, t[1:], t[2:]):
            c = sum(u[x[2]] for u in uni)
            k, fs = parts(lambda t, k: t[0][k] + t[1][k], sum(n), *x)
            base += math.log10((c + 0.5) / (sum(n) + 0.5 * (types + 1)))
            score += math.log10(sum(a * b for a, b in zip(weights.get(k, L.NEW), fs)))
            known += c > 0
        out.append((i, f == 2, len(t) - 2, known, sum(n), base, score))
    return out


@pytest.mark.parametrize("block_tokens, part_keys", [(3_000_000, 3_000_000), (700, 900)])
def test_scores_equal_a_recount(spark, block_tokens, part_keys):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(1, None), (2, ""), (None, "The of THE of the"), (3, "ÀB àb"), (3, "ÀB àb"), (4, "w " * 3000), (3, "other text of id 3")]
    rows += [(None, None), (5, "long " + "x" * 300_000)]
    got = L.score_documents(spark.createDataFrame([(*r, "c", 1) for r in rows], DOCS + ", fold string, block int"), block_tokens=block_tokens, part_keys=part_keys).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(recount(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-4)  # frequencies on a grid while the weights are learned


def test_held_out_documents_score_better_than_the_base(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    r = L.score_documents(df).where("held_out").selectExpr("sum(score)", "sum(base_score)", "count(*)").first()
    assert r[2] > 100 and r[0] > r[1]


def test_empty_table(spark):
    assert L.score_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_ngrams_are_on_disk_in_turns(spark, monkeypatch):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, real, seen = spark.conf.get(key), L.bucketed, []

    def spy(df, name, *rest):
        if name == "counts":
            seen.append((spark.conf.get(key), sorted(r.kind for r in df.select("kind").distinct().collect())))
        return real(df, name, *rest)

    monkeypatch.setattr(L, "bucketed", spy)
    docs = spark.createDataFrame([(i, f"a b {i} c") for i in range(20)], DOCS)
    assert L.score_documents(docs).count() == 20
    assert seen == [("true", [L.TRI]), ("true", [L.UNI, L.BI])]  # shuffle files of a turn go before the next
    assert spark.conf.get(key) == setting
