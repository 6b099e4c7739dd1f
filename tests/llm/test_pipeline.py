"""The pipeline against a plain Python version of its stages."""

import corpus_pipeline as C
from test_dedup import components, jaccard, slow_fingerprint, slow_shingles
from test_filters import slow_dedup, slow_mix, split

from meridian.llm import mixing as M
from meridian.llm import quality_rules as Q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_pipeline(spark, rows):
    """(doc_id, words) of every copy that the mix takes, as a sorted list."""
    kept = {r.doc_id for r in Q.apply_rules(spark.createDataFrame(rows, SCHEMA)).where("kept").collect()}
    rows = [r for r in rows if r[0] in kept]
    cleaned = []
    for r, (text, _, rep, near) in zip(rows, slow_dedup([(r[0], r[1]) for r in rows])):
        if not (rep + near and not split(text)):
            cleaned.append((r[0], text, r[3]))
    fp = {i: slow_fingerprint(t, 5) for i, t, _ in cleaned}
    sets = {i: slow_shingles(t, 5) for i, t, _ in cleaned}
    links = [(a, b) for a in fp for b in fp if a < b and (bin(fp[a] ^ fp[b]).count("1") <= 3 or jaccard(sets[a], sets[b]) >= 0.8)]
    first = components(fp, links)
    mixed, _ = slow_mix([(i, t, s) for i, t, s in cleaned if first[i] == i], M.LEAST_SHARDS, 0)
    return sorted((i, p[1]) for i, _, _, pieces in mixed for p in pieces)


def run(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k < len(C.STAGES) - 1:
            assert docs.columns == C.COLUMNS
    return [spark.read.parquet(str(tmp_path / f"s{k}")) for k in range(len(C.STAGES))]


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(C.COLUMNS).collect()]
    stages = run(spark, rows, tmp_path)
    want = slow_pipeline(spark, rows)
    mixed = sorted((r.doc_id, len(split(r.text))) for r in stages[3].collect())
    assert mixed == want
    packed = stages[4].toPandas()
    assert packed.words.sum() == sum(n for _, n in want)
    assert packed.groupby("doc_id").words.sum().to_dict() == {i: sum(n for j, n in want if j == i) for i in {i for i, _ in want}}
    fill = packed.groupby("bin").agg(w=("words", "sum"), c=("capacity", "first"))
    assert (fill.w <= fill.c).all()


def test_pipeline_run_gives_the_last_stage(spark):
    assert C.run(spark, SF).columns == ["doc_id", "piece", "first_word", "words", "bin", "capacity", "start"]


def test_pipeline_on_empty_null_and_repeated_rows(spark, tmp_path):
    good = "the cat of the house sat in the sun and a dog with it was on the mat for hours " * 1
    more = " ".join(f"word{i} the of" for i in range(30))
    rows = [(None, more, None, None, None), (1, good + "x y z", "en", None, None), (1, good + "x y z", "en", None, None),
            (2, None, "en", "s", None), (3, "", None, "s", 0), (4, more + " extra", "en", "s", 3)]
    stages = run(spark, rows, tmp_path)
    # the only line of the document without id is a word away from document 4's; the twins are one document
    assert sorted(r.doc_id for r in stages[2].collect()) == [1, 4]
    assert stages[4].count() > 0
    for k, s in enumerate(run(spark, [], tmp_path / "none")):
        assert s.count() == 0, k


def test_mix_keeps_texts_of_equal_length_without_id_apart(spark):
    rows = [(None, t, "en", "s", None) for t in ("a b c", "d e f", "g h i", "j k l")] + [(7, "m n o", "en", "s", None), (7, "p q r", "de", "s", None)]
    got = [r.text for r in C.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()]
    assert {r[1] for r in rows} <= set(got)
    assert sum(len(split(t)) for t in got) == 27 and all(got.count(r[1]) <= 2 for r in rows)


def test_dedup_keeps_texts_of_one_id_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = " ".join(f"a{i}" if i != 30 else "zz" for i in range(60))
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (None, c, "en", "s", 1), (None, near, "en", "s", 1), (None, c, "de", "s", 1), (7, c, "en", "s", 1), (9, b, "en", "s", 1), (9, b, "en", "s", 1)]
    got = sorted((r.doc_id, r.text) for r in C.dedup_documents(spark, spark.createDataFrame(rows, SCHEMA), SF).collect())
    assert got == sorted([(5, a), (5, b), (7, c)])
