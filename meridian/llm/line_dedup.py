"""Line dedup: a deletion-neighbourhood join over the words of lines; the earliest line stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import discard, materialize

#: Lines with fewer words are left alone, and lines with fewer words match only when their words
#: are equal: one edit in this many words keeps 4/5 of the line.
MIN_WORDS = 1
NEAR_WORDS = 5
#: An odd multiplier, so that powers have inverses modulo 2^64.
BASE = 0x9E3779B97F4A7C15
LAST = (1 << 63) - 1
#: The place of a line, in the order of places, as columns of their own.
FIRST = ["first_id", "first_row", "first_line"]


class _Powers:
    """Powers of BASE and of its inverse, modulo 2^64, as long as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
                for b in (BASE, pow(BASE, -1, 1 << 64))
            )
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread a hash over all bits (the finaliser of 64-bit MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _prefix_sums(words: list[bytes]) -> np.ndarray:
    """S[i]: hash of the first i words, a polynomial in BASE of their 64-bit hashes."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(len(h))[0], dtype=np.uint64)])


def line_table(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """Lines with at least ``min_words`` words of ``docs(id, row, text)``: id, row, line, a 128-bit hash (h1, h2), and for
    lines with ``near_words`` words or more the hashes of their halves (k1 to k4). The hash of a
    shorter line is that of its words.

    If one edit makes two lines equal then they agree in their first or in their last h words, h
    being half the words of the shorter. A line is the shorter or one word longer, hence up
    to four halves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids, rows, lines, hashes, counts, words = [], [], [], [], [], []
                for doc, row, text in zip(*(c.to_pylist() for c in part.columns[:2]), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    for k, line in enumerate((text or b"").split(b"\n")):
                        ws = line.split()
                        if len(ws) >= min_words:
                            ids.append(doc)
                            rows.append(row)
                            lines.append(k)
                            hashes.append(xxhash.xxh3_128_digest(line if len(ws) >= near_words else b" ".join(ws)))
                            counts.append(len(ws))
                            words += ws
                n = np.array(counts, dtype=np.int64)
                s = _prefix_sums(words)
                down = _powers(len(words) + 1)[1]
                start = np.cumsum(n) - n

                def segment(a, length, kind):
                    x = (s[a + length] - s[a]) * down[a]  # noqa: B023
                    return _mix(_mix(x) + (2 * length + kind).astype(np.uint64)).view(np.int64)

                small = n < near_words
                odd = n % 2 == 1
                cols = []
                for half, none in ((n // 2, small), ((n - 1) // 2, small | odd)):
                    cols.append(pa.array(segment(start, half, 0), mask=none))
                    cols.append(pa.array(segment(start + n - half, half, 1), mask=none))
                h = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(lines, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), *cols],
                    names=["id", "row", "line", "h1", "h2", "k1", "k2", "k3", "k4"],
                )

    return docs.mapInArrow(run, "id long, row long, line int, h1 long, h2 long, k1 long, k2 long, k3 long, k4 long")


def variant_rows(lines: DataFrame) -> DataFrame:
    """The deletion neighbourhood of each line: its own hash (pos -1) and the hash of the line without its
    word pos, for every pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, pos, rows = [], [], []
                for r, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    s = _prefix_sums(text.split())
                    n = len(s) - 1
                    down = _powers(2)[1][1]
                    without = s[:-1] + (s[-1] - s[1:]) * down
                    keys.append(_mix(np.append(without, s[-1])))
                    pos.append(np.append(np.arange(n), -1))
                    rows.append(np.full(n + 1, r))
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(pos).astype(np.int32)),
                     *(part.column(c).take(take) for c in FIRST)],
                    names=["key", "pos", *FIRST],
                )

    return lines.mapInArrow(run, "key long, pos int, first_id long, first_row long, first_line int")


def within_one_edit(a: list, b: list) -> bool:
    """Whether one insertion, deletion or substitution (or none) turns one list into the other."""
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    k = 0
    while k < min(n, m) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if n == m else a[k:] == b[k + 1 :] if n < m else a[k + 1 :] == b[k:]


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("text", "other_text"))
            ok = [within_one_edit(x.encode().split(), y.encode().split()) for x, y in zip(a, b, strict=True)]
            yield batch.select(FIRST).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, "first_id long, first_row long, first_line int")


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Places (first_id, first_row, first_line) of the lines of ``distinct`` that have an earlier line within one word edit.

    Only lines that share a half with another line can have one, so only these write their
    deletion neighbourhood, and of that only keys that occur twice go on. Lines that lose the same
    place to the same rest differ by a substitution; a line equal to another's variant differs by a
    deletion. Per key only the earliest line is kept (a minimum, so a key that very many lines
    share costs one row) and joined back; the pair is then verified on its words.
    """
    halves = distinct.select("first", F.explode(F.array("k1", "k2", "k3", "k4")).alias("half")).where("half is not null")
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    candidates = halves.join(shared, "half", "left_semi").select("first.*").distinct()
    by_doc = candidates.groupBy("id", "row").agg(F.collect_list("line").alias("want"))
    texts = (
        docs.join(by_doc, ["id", "row"])
        .select("id", "row", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), F.explode("want").alias("line"))
        .select(F.col("id").alias("first_id"), F.col("row").alias("first_row"), F.col("line").alias("first_line"), F.get("lines", F.col("line")).alias("text"))
        .where("text is not null")
        .dropDuplicates(FIRST)
    )
    texts = materialize(texts, "candidate-lines")
    variants = variant_rows(texts)
    twice = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    variants = materialize(variants.join(twice, "key", "left_semi"), "variants")
    own = F.struct(*FIRST)
    least = F.min(own).alias("least")
    places = variants.where("pos >= 0").groupBy("key", "pos").agg(least, F.count("*").alias("n")).where("n > 1").drop("n")
    rests = variants.groupBy("key").agg(
        F.min(F.when(F.col("pos") < 0, own)).alias("whole"), F.min(F.when(F.col("pos") >= 0, own)).alias("part")
    ).where("whole is not null and part is not null")
    found = variants.join(places, ["key", "pos"]).select(own.alias("own"), "least").unionByName(
        variants.join(rests, "key").select(own.alias("own"), F.when(F.col("pos") < 0, F.col("part")).otherwise(F.col("whole")).alias("least"))
    )
    found = found.where("least < own").groupBy("own").agg(F.min("least").alias("least"))
    other = texts.select(*[F.col(c).alias(f"o_{c}") for c in FIRST], F.col("text").alias("other_text"))
    pairs = (
        found.select("own.*", *[F.col(f"least.{c}").alias(f"o_{c}") for c in FIRST])
        .join(texts, FIRST)
        .join(other, [f"o_{c}" for c in FIRST])
        .select(*FIRST, "text", "other_text")
    )
    near = materialize(_verified(pairs).distinct(), "near-lines")
    discard(variants)
    discard(texts)
    return near


def _with_place(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with __meridian_id and __meridian_row, which name a document and put it in order.

    Equal texts with equal ids are one document, so a hash of the text tells those with an id
    apart; rows without id are all documents of their own and numbered once in a written table.
    """
    placed = docs.withColumn("__meridian_id", F.col(id_col).cast("long"))
    named = placed.where("__meridian_id is not null").withColumn("__meridian_row", F.xxhash64(F.col(text_col).cast("string")))
    unnamed = placed.where("__meridian_id is null").withColumn("__meridian_row", F.monotonically_increasing_id())
    unnamed = materialize(unnamed.withColumn("__meridian_id", F.lit(LAST)), "rows-without-id")
    return named.unionByName(unnamed)


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    near_words: int = NEAR_WORDS,
) -> DataFrame:
    """``docs`` with repeated and near-repeated lines taken out of the text, and the columns
    n_lines, n_repeated and n_near (lines of the text, and those dropped as equal to, or within one
    word edit of, an earlier line).

    Lines are what ``\\n`` separates; words are split at ASCII white space. A line with at least
    ``min_words`` words goes if an equal line stands earlier, in the order of (id, row, line number);
    with fewer than ``near_words`` words its words count, not its spaces; with ``near_words`` or more it
    also goes if an earlier line of so many words, dropped or not, is within one insertion, deletion or
    substitution of a word. Other lines stay. Null texts stay null (no lines) and empty ones empty. Rows
    with equal ids and texts count as one document and lose the same lines; equal ids with different
    texts are documents apart, in the order of a hash of the text. Rows with null ids come last, each
    a document of its own. Columns of ``docs`` named like the added ones are replaced, others pass through; an empty
    table gives an empty table.
    """
    docs = _with_place(docs, id_col, text_col)
    narrow = docs.select(F.col("__meridian_id").alias("id"), F.col("__meridian_row").alias("row"), F.col(text_col).cast("string").alias("text"))
    lines = materialize(line_table(narrow, min_words, near_words), "lines")
    distinct = materialize(
        lines.groupBy("h1", "h2").agg(
            F.min(F.struct("id", "row", "line")).alias("first"), *[F.first(k).alias(k) for k in ("k1", "k2", "k3", "k4")]
        ),
        "distinct-lines",
    )
    near = near_lines(narrow, distinct)
    marks = near.select(F.struct(*[F.col(c).alias(c[6:]) for c in FIRST]).alias("first"), F.lit(True).alias("near"))
    verdict = distinct.select("h1", "h2", "first").join(marks, "first", "left")
    dropped = (
        lines.select("id", "row", "line", "h1", "h2")
        .join(verdict, ["h1", "h2"])
        .withColumn("repeated", F.struct("id", "row", "line") != F.col("first"))
        .where("repeated or near")
        .groupBy(F.col("id").alias("__meridian_id"), F.col("row").alias("__meridian_row"))
        .agg(
            F.collect_set(F.when(F.col("repeated"), F.col("line"))).alias("__meridian_repeated"),
            F.collect_set(F.when(~F.col("repeated"), F.col("line"))).alias("__meridian_near"),
        )
    )
    dropped = materialize(dropped.withColumn("__meridian_drops", F.lit(True)), "dropped-lines")
    for used in (lines, distinct, near):
        discard(used)
    none = F.array().cast("array<int>")
    # the list of dropped lines grows with the documents: a merge join at every size
    out = docs.drop("n_lines", "n_repeated", "n_near").join(dropped.hint("merge"), ["__meridian_id", "__meridian_row"], "left")
    pieces = F.split(F.col(text_col), "\n")
    gone = F.concat(F.coalesce("__meridian_repeated", none), F.coalesce("__meridian_near", none))
    kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), gone)
    rebuilt = F.array_join(F.transform(kept, lambda i: F.get(F.col("__meridian_pieces"), i)), "\n")
    return (
        out.withColumn("__meridian_pieces", pieces)
        .withColumns(
            {
                "n_lines": F.coalesce(F.size("__meridian_pieces"), F.lit(0)).cast("long"),
                "n_repeated": F.coalesce(F.size("__meridian_repeated"), F.lit(0)).cast("long"),
                "n_near": F.coalesce(F.size("__meridian_near"), F.lit(0)).cast("long"),
                text_col: F.when(F.col("__meridian_drops").isNull(), F.col(text_col)).otherwise(rebuilt),
            }
        )
        .withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")))
        .drop("__meridian_id", "__meridian_row", "__meridian_drops", "__meridian_repeated", "__meridian_near", "__meridian_pieces")
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line, ls[i] AS line_text, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS r(i)),
b AS (SELECT *, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE line_text END AS form FROM l WHERE len(w) >= 1),
f AS (SELECT *, row_number() OVER (ORDER BY doc_id, line) AS pos_no FROM (
  SELECT *, row_number() OVER (PARTITION BY form ORDER BY doc_id, line) AS k FROM b) WHERE k = 1),
v AS (
  SELECT pos_no, len(w) AS n, p, array_to_string(w[:p - 1] || w[p + 1:], ' ') AS key FROM f, unnest(range(1, len(w) + 1)) AS r(p) WHERE len(w) >= 5
  UNION ALL SELECT pos_no, len(w), 0, array_to_string(w, ' ') FROM f WHERE len(w) >= 5),
s AS (
  SELECT pos_no, min(pos_no) FILTER (p > 0) OVER (PARTITION BY key, p) AS same_place, p,
         min(pos_no) FILTER (p = 0) OVER (PARTITION BY key) AS whole, min(pos_no) FILTER (p > 0) OVER (PARTITION BY key) AS part FROM v),
nr AS (
  SELECT DISTINCT pos_no FROM s
  WHERE (p > 0 AND (same_place < pos_no OR whole < pos_no)) OR (p = 0 AND (part < pos_no OR whole < pos_no))),
d AS (
  SELECT b.doc_id, b.line, CASE WHEN f.doc_id <> b.doc_id OR f.line <> b.line THEN 'r' ELSE 'n' END AS why
  FROM b JOIN f ON b.form = f.form LEFT JOIN nr ON f.pos_no = nr.pos_no
  WHERE f.doc_id <> b.doc_id OR f.line <> b.line OR nr.pos_no IS NOT NULL),
k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (why = 'r') AS n_repeated, count(*) FILTER (why = 'n') AS n_near,
         coalesce(string_agg(line_text, chr(10) ORDER BY l.line) FILTER (why IS NULL), '') AS text
  FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.line = d.line GROUP BY l.doc_id)
SELECT documents.doc_id, k.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_near, 0) AS n_near
FROM documents LEFT JOIN k ON documents.doc_id = k.doc_id
"""
