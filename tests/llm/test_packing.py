"""Packing and token output: nothing lost, nothing doubled, and as tight as the method says."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meridian.llm import packing as P
from meridian.llm import token_output as T

DOCS = "doc_id long, text string"


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=80, deadline=None)
def test_pool_is_best_fit(sizes):
    caps, overhead, attention = (16, 32, 64), 3, 400
    where, start, capacity = P.pack_pool(np.array(sizes, dtype=np.int64), caps, overhead, attention)
    room, fill = [], []
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    for at, i in enumerate(order):

        def cost(c):
            free = c - sizes[i]
            for j in order[at + 1 :]:
                free -= sizes[j] if sizes[j] <= free else 0
            return ((overhead + c + c * c / attention) / (c - free), c)

        open_ = [b for b in range(len(room)) if room[b] >= sizes[i]]
        if open_:
            assert room[where[i]] == min(room[b] for b in open_)  # least room that holds it
        else:
            assert where[i] == len(room)
            room.append(min((c for c in caps if c >= sizes[i]), key=cost))
            fill.append(0)
        assert start[i] == fill[where[i]]
        room[where[i]] -= sizes[i]
        fill[where[i]] += sizes[i]
    assert capacity == [min(c for c in caps if c >= f) for f in fill]


def test_pack_covers_every_word(spark):
    rows = [(i, "w " * n) for i, n in enumerate([0, 1, 5, 300, 2048, 2049, 5000, 7, 7, 900, 1100])] + [(None, "a b"), (3, None), (7, "w " * 7)]
    out = P.pack(spark.createDataFrame(rows, DOCS), pool_rows=4).toPandas()
    for i, n in [(4, 2048), (5, 2049), (6, 5000), (9, 900)]:
        mine = out[out.doc_id == i].sort_values("piece")
        assert mine.words.sum() == n and (mine.first_word == np.r_[0, mine.words.cumsum()[:-1]]).all()
    assert out.words.sum() == sum(len((t or "").split()) for _, t in rows)
    assert out[out.doc_id.isna()].words.tolist() == [2]
    assert out[out.words == 0].bin.isna().all() and (out.words == 0).sum() == 2
    full = out[out.words > 0].groupby("bin").agg(w=("words", "sum"), c=("capacity", "first"), n=("capacity", "nunique"))
    assert (full.w <= full.c).all() and (full.n == 1).all()
    assert (full.w > full.c.map({256: 0, 512: 256, 1024: 512, 2048: 1024})).all()  # downsized
    for _, g in out[out.words > 0].sort_values("start").groupby("bin"):
        assert g.start.tolist() == [0, *g.words.cumsum().tolist()[:-1]]
    assert P.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_pools_do_not_follow_ids(spark):
    """Rows of one id and length, or of no id, are dealt to many pools."""
    rows = [(None, "a b c", 1, "x") for _ in range(200)] + [(4, "a b c d", 1, "x") for _ in range(200)] + [(5, "w " * 1_000_000, 1, "x")]
    out = P.pack(spark.createDataFrame(rows, DOCS + ", size int, bin string"), pool_rows=50).toPandas()
    assert out.words.sum() == 200 * 7 + 1_000_000
    pools = out[out.words < 5].groupby("words").bin.agg(lambda b: b.str.split("-").str[0].nunique())
    assert (pools > 4).all()


def test_several_lengths_are_opened(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = P.pack(docs).where("bin is not null").groupBy("capacity").agg({"bin": "count"}).collect()
    assert {r.capacity for r in got} >= {512, 1024, 2048}


def test_encoding_of_long_texts_equals_the_plain_encoder(monkeypatch):
    enc = T.tokenizer()
    rng = random.Random(3)
    alphabet = "ab'sdmtlvre 12.,#\n\t   ü漢🎉\x1c\x85 "
    monkeypatch.setattr(T, "STEP", 50)
    monkeypatch.setattr(T, "GAP", T.re.compile(f"[{T.BLANK}]{{3,}}"))
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) * rng.choice((1, 1, 1, 2, 5)) for _ in range(rng.randrange(60)))
        assert T.encode(enc, text).tolist() == enc.encode_ordinary(text)


def test_gaps_and_words_of_any_length(spark):
    enc = T.tokenizer()
    texts = [" " * 1_000_000, "\n" * 1_000_000 + "end", "x" * 10_000_000, "some words and " * 700_000 + "\t" * 5000]
    for text in texts:
        assert enc.decode(T.encode(enc, text).tolist()) == text
    rows = T.token_rows(spark.createDataFrame([*enumerate(texts)], DOCS).selectExpr("*", "1 AS ids", "2 AS length")).selectExpr("sum(length)").first()[0]
    assert rows == sum(len(T.encode(enc, t)) + 1 for t in texts)


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(max_examples=80, deadline=None)
def test_segment_tree_best_fit(sizes):
    bins = T.best_fit_decreasing(np.array(sizes, dtype=np.int64), 40)
    room, want = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [r for r in room if r >= sizes[i]]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - sizes[i])
        else:
            room.append(40 - sizes[i])
    got = sorted(40 - sum(sizes[i] for i in b) for b in bins)
    assert got == sorted(room) and sorted(i for b in bins for i in b) == list(range(len(sizes)))


@pytest.mark.parametrize("end", [50256, None])
def test_token_round_trip(spark, tmp_path, end):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "naïve 日本語 " * 400), (5, "a" * 9000), (6, "x"), (6, "x"), (None, "nul\x00l <|endoftext|>")]
    df = T.token_rows(spark.createDataFrame(rows, DOCS), seq_len=128, end_id=end, pool_tokens=700)
    T.write_token_rows(df, str(tmp_path / "ids"))
    back = spark.read.parquet(str(tmp_path / "ids")).collect()
    enc, parts = T.tokenizer(), {}
    for r in back:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 128 and (ids[r.length :] == 50256).all() and r.cu_seqlens[-1] == r.length
        assert r.position_resets == r.cu_seqlens[:-1]
        pos = T.positions(r.cu_seqlens, 128)
        assert len(pos) == 128 and all(pos[x] == 0 for x in r.position_resets)
        for k, (d, first) in enumerate(zip(r.doc_ids, r.doc_starts)):
            parts.setdefault(d, []).append((first, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()))
    for i, text in {r[0]: r[1] for r in rows}.items():
        got = [t for _, p in sorted(parts.get(i, [])) for t in p]
        want = enc.encode_ordinary(text or "") + ([end] if end is not None else [])
        assert got == (want * 2 if i == 6 else want)
    assert sum(len(m) for m in T.read_id_matrix(str(tmp_path / "ids"), 128)) == len(back)
    assert T.token_rows(spark.createDataFrame([], DOCS)).count() == 0
