"""Personal data: the base spans against the patterns as given, and what the method adds."""

import hashlib
import random
import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from meridian.llm import pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out)]


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.find_pii(df).select("doc_id", pii.spelled(pii.F.col("base")).alias("base"), pii.spelled(pii.F.col("spans")).alias("spans")).collect()
    for r in got:
        assert [x for x in r.base.split(",") if x] == base_spans(texts[r.doc_id]), texts[r.doc_id]
        assert set(r.base.split(",")) <= set(r.spans.split(",")) or not r.base
    assert len(got) == len(texts)
    return {r.doc_id: r.spans.split(",") for r in got}


def test_base_spans_on_hard_texts(spark):
    check(spark, [
        None, "", "a@b.com_x@y.com z@w", "x%y@a-b.c.d. e@f", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.255.0 1.2.3", "1.2.3.4444 99999999999999999999.1.1.1",
        "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111  1111 1111 1111", "4111111111111111 4111111111111111", "12" * 40,
        "+1 (456) 555-2186 + 1 2 +12 +1234567890123456789 +44 20 7946 0958.", "日本 ünï a@b.co +49 30 1234567 🎉 10.0.0.1", "7" * 3000, "a" * 3000 + "@b.c",
        "+1+2+3 45678901 ()+1 234 567 89 0-", "0000 0000 0000 0000 0", "a@b.c@d.e", "@a.b x@.b y@c. z@c..d",
    ])


@given(st.lists(st.text(alphabet="0123456789 .-+()@ab_%\nÜ", max_size=60), min_size=30, max_size=30))
@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
def test_base_spans_on_random_texts(spark, texts):
    check(spark, texts)


def test_query_on_a_table(spark):
    from meridian.llm.pii import op7_pii

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in op7_pii(spark, sf).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k, _ in BASE]
        assert set(want) <= set(r.spans.split(",")) or not want


def test_method_adds_marked_spans_and_not_plain_numbers(spark):
    clean = [f"In {1900 + i} there were {i * 37} people and version 3.{i}.1 cost 12,{i:03d} dollars" for i in range(60)]
    marked = [f"reach me at a{i}@mail{i}.example.com or +1 (555) 010-{1000 + i}" for i in range(60)]
    local = [f"please call 555-123-{4000 + i} now" for i in range(30)]
    names = [f"we met Dr. Maria Lopez there {i}" for i in range(10)]
    got = check(spark, clean + marked + local + names)
    assert all(got[i] == [""] for i in range(60))
    assert all(any(x.startswith("phone:") for x in got[i]) for i in range(120, 150))
    assert all(any(x.startswith("name:") for x in got[i]) for i in range(150, 160))


def test_added_spans_on_planted_data(spark):
    """Precision and recall of what the method adds: every planted span has a place, every decoy is a near miss."""
    rng = random.Random(7)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    token = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    planted = {
        "phone": lambda: f"{rng.choice(['call', 'tel:', 'mobile', 'fax'])} {rng.randrange(200, 999)}-555-{digits(4)}",
        "id": lambda: f"{rng.choice(['SSN', 'social security:', 'ssn is'])} {rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
        "name": lambda: f"{rng.choice(['Dr.', 'Mrs', 'Herr', 'Prof.'])} {rng.choice(['Anna Keller', 'Paul Novak', 'Inés Ruiz', 'Tom Baker'])}",
        "secret": lambda: rng.choice(['token = "', "api_key: ", "password='", "secret "]) + token(40),
    }
    decoys = [
        lambda: f"order {digits(16)} left", lambda: f"version {rng.randrange(300, 999)}.{digits(2)}.4.1", lambda: f"in {rng.randrange(1900, 2030)} about {digits(5)}",
        lambda: "a wordwithoutanydigitsinitatall here", lambda: f"pages {digits(3)}-{digits(3)} of it", lambda: "the doctor came with professor of law",
    ]
    words = "the rain fell over old roofs while people walked home in the evening".split()
    filler = lambda: " ".join(rng.sample(words, 6))
    texts, want = [], {}
    for i in range(240):
        kind = list(planted)[i % 4] if i % 2 else None
        said = planted[kind]() if kind else rng.choice(decoys)()
        texts.append(f"{filler()} {said} {filler()} {rng.choice(decoys)() if i % 3 else ''}")
        want[i] = kind
    texts += [f"mail a{i}@b.com or +1 (555) 01{i}-1234" for i in range(30)]
    got = check(spark, texts)
    added = {i: [x.split(":")[0] for x in got[i] if x and x not in base_spans(texts[i])] for i in range(240)}
    right = sum(want[i] in added[i] for i in want if want[i])
    wrong = sum(len([k for k in added[i] if k != want[i]]) for i in want)
    assert right >= 0.9 * 120 and wrong <= 0.05 * right, (right, wrong, Counter((want[i], *added[i]) for i in want))


def test_places_of_many_matches(spark, monkeypatch):
    monkeypatch.setattr(pii, "CHUNK", 4)
    check(spark, [" ".join(f"a{i}@b.c" for i in range(n)) + " é 🎉" for n in (1, 3, 4, 5, 16, 17, 63)])


def test_very_long_text_of_matches(spark):
    df = spark.createDataFrame([(1, "a@b.co " * 60_000), (None, "1" * 2_000_000), (None, None), (3, "x@y.zz"), (3, "x@y.zz"), (3, "none")],
                               "doc_id long, text string").selectExpr("*", "1 AS s", "'x' AS found")
    got = sorted((r[0] or 0, len(r.base)) for r in pii.find_pii(df).collect())
    assert got == [(0, 0), (0, 0), (1, 60_000), (3, 0), (3, 1), (3, 1)]


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
