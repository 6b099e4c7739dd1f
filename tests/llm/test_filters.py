"""Quality rules, line dedup, mixing and sharding: brute force, invariants and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from math import comb

import pytest

from meridian.llm import line_dedup as L
from meridian.llm import mixing as M
from meridian.llm import quality_rules as Q
from meridian.llm import sharding as S

SF = "/root/testdata/sf0.001"
SPACE = "[\x20\x09-\x0d]+"


def split(text):
    return [w for w in re.split(SPACE, text or "") if w]


def slow_measures(text):
    text = text or ""
    w = split(text)
    lines = [x for x in text.split("\n") if split(x)]
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}


TEXTS = [None, "", " \n\t ", "one", "a b c d e f g h " * 9, "x " * 25, "l1 w\nl1 w\n\n\nl1 w\nl2", "🎉 é ü # $ % & | < >" * 3,
         "the quick brown fox jumps over the lazy dog and then sleeps in the sun with a cat of the house for hours", "v " * 50_000, "q" * 200_000]


def test_quality_counts_equal_plain_python(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Q.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    for r in got:
        want = slow_measures(texts[r.doc_id])
        assert {k: r.quality[k] for k in want} == want
        assert r.base_failed == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        assert r.kept == (not r.base_failed and not r.failed_rules)
    assert {r.doc_id: r.kept for r in got}[8]


def test_quality_plan_is_one_projection(spark):
    plan = Q.op4_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_quality_keeps_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, kept string, n_words int")
    assert set(Q.apply_rules(df).columns) == {"doc_id", "text", "kept", "n_words", "quality", "failed_rules", "base_failed"}
    assert Q.apply_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def near(a, b):
    return L.within_one_edit(split(a), split(b))


def slow_dedup(rows):
    """(text, lines, repeated, near) of every row; rows in order, ids distinct."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = [], [None] * len(rows)
    for i in order:
        text = rows[i][1]
        if text is None:
            out[i] = (None, 0, 0, 0)
            continue
        keep, rep, nr = [], 0, 0
        for line in text.split("\n"):
            n = len(split(line))
            if n >= L.MIN_WORDS and line in seen:
                rep += 1
                continue
            fuzzy = n >= L.NEAR_WORDS and any(len(split(x)) >= L.NEAR_WORDS and near(line, x) for x in seen)
            if n >= L.MIN_WORDS:
                seen.append(line)
            if fuzzy:
                nr += 1
            else:
                keep.append(line)
        out[i] = ("\n".join(keep), text.count("\n") + 1, rep, nr)
    return out


def line_rows():
    base = "the cat sat on a mat with eight other cats"
    w = base.split()
    edits = [" ".join(w[:i] + w[i + 1 :]) for i in range(0, 10, 3)] + [" ".join(w[:i] + ["zz"] + w[i:]) for i in range(0, 11, 2)]
    edits += [" ".join(w[:i] + ["yy"] + w[i + 1 :]) for i in range(10)] + [" ".join(w[:2] + ["p"] + w[3:7] + ["q"] + w[8:])]
    rows = [(10, base + "\n" + base), (3, None), (4, ""), (5, "\n\n"), (7, "short line\nshort line"), (11, "five words are enough here\nfive words are enough here")]
    rows += [(100 + i, f"intro {i} stays\n{e}\n tail {i}") for i, e in enumerate(edits)]
    rows += [(200 + i, f"row {i} of the very same kind as all of these") for i in range(30)]
    rows += [(300, "a a a a a a a a a\nb a a a a a a a a\na a a a a a a a"), (None, base), (301, "éé üü " * 6 + "\r\n\x85 x")]
    return rows


def test_line_dedup_equals_all_pairs(spark):
    rows = line_rows() + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    got = {r.doc_id: (r.text, r.n_lines, r.n_repeated, r.n_near) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, _), want in zip(rows, slow_dedup(rows)):
        assert got[i] == want, i


def test_line_dedup_edge_cases(spark):
    twin = "these five words stand twice"
    df = spark.createDataFrame([(1, twin, "a", 5), (1, twin, "b", 6), (2, twin, "c", 7)], "doc_id long, text string, h1 string, n_near int")
    got = sorted((r.doc_id, r.h1, r.text, r.n_repeated) for r in L.dedup_lines(df).collect())
    assert got == [(1, "a", twin, 0), (1, "b", twin, 0), (2, "c", "", 1)]
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_keeps_rows_of_one_id_apart(spark):
    line = "this line of five words"
    rows = [(1, f"{line}\nanother line that stands once"), (None, f"{line}\nunique text of one row"), (None, f"nothing of this is elsewhere\n{line}"),
            (None, f"{line}\nwhat only another row holds"), (5, "first text of the id five"), (5, f"{line}\nsecond text of id five"),
            (None, "only rows without id hold this"), (None, "only rows without id hold this")]
    got = sorted((r.doc_id or 0, r.text) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, rows[0][1]), (0, "unique text of one row"), (0, "nothing of this is elsewhere"), (0, "what only another row holds"),
                          (5, rows[4][1]), (5, "second text of id five"), (0, rows[6][1]), (0, "")])


def test_line_dedup_matches_short_lines(spark):
    rows = [(1, "All rights reserved.\none\nfive words are enough here"), (2, "All  rights reserved.\r\n\none two"),
            (3, "one\nfive words were enough here\n \none too")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in L.dedup_lines(df).collect()} == {1: rows[0][1], 2: "\none two", 3: " \none too"}


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        level = (budget - sum(2 * sizes[s] for s in capped)) / (sum(weight[s] for s in rest) or 1)
        over = {s for s in rest if 2 * sizes[s] <= level * weight[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def hex_digest(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def quantile(u, total, marked, drawn):
    run = 0
    for x in range(max(0, drawn + marked - total), min(marked, drawn) + 1):
        run += comb(marked, x) * comb(total - marked, drawn - x)
        if run >= u * comb(total, drawn):
            return x
    return min(marked, drawn)


def slow_split(quotas, shards, seed, lo=0, hi=None, total=None):
    """{shard: [quota of each unit]} by the tree, one draw after the other."""
    hi, total = (shards, sum(quotas)) if hi is None else (hi, total)
    if hi - lo == 1:
        return {lo: quotas}
    mid = (lo + hi + 1) // 2
    left, rest, got = mid * total // shards - lo * total // shards, sum(quotas), []
    for j, q in enumerate(quotas):
        u = int(hex_digest(seed, "tree", 0, lo, hi, j)[:13], 16) / (1 << 52)
        got.append(quantile(u, rest, q, left - sum(got)) if q else 0)
        rest -= q
    both = (got, lo, mid), ([q - x for q, x in zip(quotas, got)], mid, hi)
    return {k: v for q, a, b in both for k, v in slow_split(q, shards, seed, a, b, total).items()}


def slow_mix(rows, shards, seed):
    """(id, size, source, pieces) of every row, in plain Python; pieces are (copy, words, block, shard)."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(split(t))
    want = {s: math.floor(x + 0.5) for s, x in targets(sizes).items()}
    block = max(1, -(-sum(want.values()) // (shards * M.BLOCKS_PER_SHARD)))
    key = {s: "n" if s is None else "s" + s for s in sizes}
    order = lambda i, t: hex_digest(seed, "null" if i is None else i, "null" if t is None else hashlib.md5(t.encode()).hexdigest())
    names, lines, drawn, out = sorted(sizes, key=lambda s: (s is None, s or "")), {}, {}, []
    for s in names:
        at, lines[s], blocks = 0, [], {}
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: order(*r[:2])):
            n = len(split(r[1]))
            lines[s].append((r, n, at))
            if n:
                first, words = blocks.get(at // block, (at, 0))
                blocks[at // block] = (first, words + n)
            at += n
        drawn[s], left = [], want[s]
        for c in range(want[s] // at + 1 if at else 0):
            for b in sorted(blocks, key=lambda b: hex_digest(seed, "block", key[s], b)):
                took = min(blocks[b][1], left)
                if took > 0:
                    drawn[s].append((b, c, took, blocks[b][0]))
                left -= took
    shares = slow_split([len(drawn[s]) for s in names], shards, seed)
    for j, s in enumerate(names):
        dealt = [k for k in range(shards) for _ in range(shares[k][j])]
        ranked = sorted(drawn[s], key=lambda d: hex_digest(seed, "draw", key[s], d[0], d[1]))
        of = {(d[0], d[1]): (d, k) for d, k in zip(ranked, dealt)}
        for r, n, at in lines[s]:
            mine = [(d[1], min(n, d[2] - (at - d[3])), d[0], k) for (b, _), (d, k) in of.items() if n and b == at // block]
            out.append((r[0], n, s, tuple(sorted(p for p in mine if p[1] > 0))))
    return out, want


def mix_rows():
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 7 if i % 3 else 0}" if i % 11 else None) for i in range(300)]
    rows += [(300, None, "s1"), (301, "", "empty"), (None, "a b c", "s2"), (None, "d e f", "s2"), (5, "w " * 36, "s5"), (5, "w " * 36, "s5"), (5, "v " * 36, "s5")]
    return rows + [(400, "long " * 5000, "s1")] + [(None, "x y", "s6")] * 40


@pytest.mark.parametrize(("seed", "shards"), [(0, 5), (1, 5), (0, 16)])
def test_mix_equals_plain_python(spark, monkeypatch, seed, shards):
    monkeypatch.setattr(M, "ROWS_PER_BUCKET", 4)
    rows = mix_rows()
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, source string, size int, key string")
    out = M.mix(df, n_shards=shards, seed=seed, carry=["size"]).collect()
    got = [(r[0], r[2], r.source, tuple(sorted(tuple(p) for p in r.pieces))) for r in out]
    want, take = slow_mix(rows, shards, seed)
    # rows equal in everything may change places
    assert Counter(got) == Counter(want)
    words, sizes = Counter(), Counter()
    for i, n, s, pieces in got:
        words[s] += sum(p[1] for p in pieces)
        sizes[s] += n
        assert sum(p[1] for p in pieces) <= 2 * n
    assert words == Counter(take) and {r.source: r.target for r in out} == pytest.approx(targets(dict(sizes)), rel=1e-12)
    by_shard = Counter(k for k in {(s, p[0], p[2], p[3]) for _, _, s, pieces in got for p in pieces} for k in [k[3]])
    assert max(by_shard.values()) - min(by_shard.values()) <= 1


def test_mix_seed_decides_what_is_taken(spark):
    df = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string")
    runs = [sorted((r.doc_id or 0, str(r.source), r.taken, str(r.pieces)) for r in M.mix(d, seed=seed).collect()) for d, seed in ((df, 0), (df.repartition(3), 0), (df, 1))]
    assert runs[0] == runs[1] and runs[0] != runs[2]


def test_quota_tree_is_exact_and_fair(spark):
    quotas = {"a": 500, "b": 37, "c": 1, "d": 0}
    got = M.split_quotas(spark.createDataFrame([(k, i, q) for i, (k, q) in enumerate(quotas.items())], "key string, unit long, blocks long"), 7).collect()
    by_key, by_shard = Counter(), Counter()
    for r in got:
        by_key[r.key] += r.quota
        by_shard[r.shard] += r.quota
    assert by_key == Counter(a=500, b=37, c=1) and set(by_shard) == set(range(7))
    assert max(by_shard.values()) - min(by_shard.values()) <= 1


def test_quota_tree_of_many_sources_is_exact_and_fair(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 3)
    quotas = [(f"k{i}", i, i % 5) for i in range(20)]
    got = M.split_quotas(spark.createDataFrame(quotas, "key string, unit long, blocks long"), 4).collect()
    by_key, by_shard = Counter(), Counter()
    for r in got:
        by_key[r.key] += r.quota
        by_shard[r.shard] += r.quota
    assert by_key == Counter({k: q for k, _, q in quotas if q}) and set(by_shard.values()) == {10}


def test_hypergeometric_quantiles(spark):
    total, marked, drawn = 30, 12, 9
    pmf = [comb(marked, x) * comb(total - marked, drawn - x) / comb(total, drawn) for x in range(10)]
    us = [i / 500 + 0.0011 for i in range(499)]
    lit = M.F.lit
    got = spark.createDataFrame([(u,) for u in us], "u double").select("u", M.hypergeometric(M.F.col("u"), lit(total), lit(marked), lit(drawn)).alias("x")).collect()
    for r in got:
        assert sum(pmf[: r.x]) <= r.u + 1e-9 and r.u <= sum(pmf[: r.x + 1]) + 1e-9


def test_mix_of_an_empty_table(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def slow_kd(rows, dims, room):
    """{row number: shard} by the k-d tree: rows are (dims..., weight, tie)."""
    spans = [max(1, max(r[i] for r in rows) - min(r[i] for r in rows)) for i in range(dims)] if rows else []
    out = {}

    def cut(mine, first, m):
        if m == 1 or not mine:
            out.update({i: first for i in mine})
            return
        d = max(range(dims), key=lambda i: (max(rows[k][i] for k in mine) - min(rows[k][i] for k in mine)) / spans[i])
        half, w = -(-m // 2), sum(rows[k][-2] for k in mine)
        whole = sum(room[first : first + m])
        want = w * (sum(room[first : first + half]) / whole if whole else half / m)
        run, left = 0, []
        for k in sorted(mine, key=lambda k: (rows[k][d], rows[k][-1])):
            if run + rows[k][-2] > want and not want - run > run + rows[k][-2] - want or want <= 0:
                break
            left.append(k)
            run += rows[k][-2]
            if run >= want:
                break
        cut(left, first, half)
        cut(sorted(set(mine) - set(left)), first + half, m - half)

    cut(list(range(len(rows))), 0, len(room))
    return out


@pytest.mark.parametrize("room", [[1.0] * 7, [3.0, 1.0, 0.0, 2.0, 2.0], [0.0, 0.0, 1.0], [1.0]])
def test_shards_equal_a_plain_kd_tree(spark, monkeypatch, room):
    monkeypatch.setattr(S, "BINS", 16)
    rng = random.Random(4)
    rows = [(rng.choice([-1, 5, 5, 5, 1 << 50]), rng.randrange(1000), rng.randrange(1, 300), rng.randrange(-(1 << 63), 1 << 63)) for _ in range(400)]
    rows += [(5, 5, 40, rng.randrange(-(1 << 63), 1 << 63)) for _ in range(100)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "a long, b long, w long, t long, i long")
    got = {r.i: r.shard for r in S.kd_shards(df, ["a", "b"], "w", "t", room, tolerance=0).collect()}
    assert got == slow_kd(rows, 2, room)


def test_boulders_leave_level_room():
    where, room = S.place_boulders([100, 30, 30, 20], 300, 4)
    loads = [sum(x for x, k in zip([100, 30, 30, 20], where) if k == j) for j in range(4)]
    assert sorted(loads) == [20, 30, 30, 100] and sum(room) == pytest.approx(120)
    assert [x + y for x, y in zip(loads, room) if y] == pytest.approx([200 / 3] * 3)
    assert S.place_boulders([], 0, 3) == ([], [0.0, 0.0, 0.0])


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards_are_near_equal_and_gapless(spark, monkeypatch, shards):
    monkeypatch.setattr(S, "ROWS_PER_BUCKET", 64)
    rows = [(i, "x" * (i * 37 % 200) + f"{i % 1000}", ["en", None, "de"][i % 3], "https://hot" if i % 3 else f"https://s{i % 5}") for i in range(2000)]
    rows += [(None, None, None, None), (7, "ü" * 9, "en", "s1"), (7, "ü" * 9, "en", "s1")] + [(3000 + i, "twins", "en", "t") for i in range(60)]
    rows += [(4000 + i, "many copies of one text", "en", "t") for i in range(700)] + [(9, "one row again and again", "en", "t")] * 700
    rows += [(5000, "longest " * 4000, "en", "s"), (5001, "long " * 400, "en", "s")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, shard int, part int")
    out = S.shard_documents(df, shards).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (i, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for i, t, *_ in rows)
    size, slots, where = Counter(), {}, {}
    for r in out:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        where.setdefault((r.text_crc32, r.size), []).append(r.shard)
    assert set(size) == set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    longest = 16 + len("longest " * 4000)
    fair = sum(size.values()) / shards
    for (_, n), v in where.items():  # only groups above a shard's bytes are cut
        assert len(set(v)) == 1 or n * len(v) > fair
    level = (sum(size.values()) - longest) / (shards - 1) if longest > fair and shards > 1 else fair
    rest = [v for v in size.values() if v < longest or longest <= fair]
    assert max(abs(v - level) for v in rest) <= 0.1 * level


def test_shards_of_an_empty_table(spark):
    assert S.shard_documents(spark.createDataFrame([], "doc_id long, text string, lang string, source string"), 4).count() == 0
