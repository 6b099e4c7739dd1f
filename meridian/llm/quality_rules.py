"""Quality rules: one threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import let, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a the of and to in is that for it was on with as by be this are or at from an have not "
    "der die das und in zu den von mit ist des ein eine nicht auf für im dem sich auch als "
    "le la les de des et un une du en que est pour dans qui par pas sur au avec "
    "el los las y del se por con una no es lo para al como su más o"
).split()

#: rule, metric, lowest and highest value that passes (None: open). One row is one rule.
THRESHOLDS: list[tuple[str, str, float | None, float | None]] = [
    ("mean_word_length", "mean_word_length", 2.0, 14.0),
    ("symbol_ratio", "symbol_ratio", None, 0.1),
    ("stop_word_ratio", "stop_word_ratio", 0.02, None),
    ("dup_line_ratio", "dup_line_ratio", None, 0.5),
    ("shouted_ratio", "shouted_ratio", None, 0.5),
]

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_shouted"]
WINDOW = 8


def _repeated_words(ws: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text.

    Windows are compared by 64-bit hash. Only a text with equal hashes pays for the
    sort that finds their positions; the covered words are then summed over the sorted
    starts, each start covering up to the next one.
    """
    starts = F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1))
    hashes = F.when(F.size(ws) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))).otherwise(
        F.array().cast("array<bigint>")
    )

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            same = F.filter(
                s,
                lambda e, k: (F.get(s, k - 1)["h"].eqNullSafe(e["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(e["h"])),
            )
            return let(F.sort_array(F.transform(same, lambda e: e["i"])), gaps)

        def gaps(p: Column) -> Column:
            reach = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(ordered, repeats)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)).cast("long"))


def measures(text: Column) -> Column:
    """All counts of a text as one struct: words and lines are split once and bound."""
    text = F.coalesce(text, F.lit(""))

    def counts(ws: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        joined = F.array_join(ws, "")
        return let(
            lines,
            lambda ls: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.length(joined).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeated_words(ws).alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
                F.size(F.filter(ws, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
                F.size(F.filter(ws, lambda w: (F.upper(w) == w) & (F.lower(w) != w))).cast("long").alias("n_shouted"),
            ),
        )

    return let(words(text), counts)


def _metrics(m: Column) -> dict[str, Column]:
    def ratio(part: str, whole: str) -> Column:
        return F.when(m[whole] > 0, m[part].cast("double") / m[whole]).otherwise(F.lit(0.0))

    return {
        "mean_word_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "shouted_ratio": ratio("n_shouted", "n_words"),
    }


def apply_rules(
    docs: DataFrame,
    text_col: str = "text",
    thresholds: list[tuple[str, str, float | None, float | None]] = THRESHOLDS,
) -> DataFrame:
    """Add the columns ``quality`` (struct of counts and verdict), ``failed_rules`` (array of rule names),
    ``base_failed`` and ``kept`` to ``docs``.

    The threshold table becomes one projection of built-in expressions: no shuffle, no
    user function. Base rule: fewer than 20 words, or over 30 % of the words in repeated
    windows. Null and empty texts have no words and fail the base rule. Other columns of
    ``docs``, whatever their names, pass through unchanged; existing columns named like the
    added ones are replaced. Rows are judged one by one, so repeated rows give equal verdicts
    and an empty table gives an empty table.
    """
    def verdict(m: Column) -> Column:
        metrics = _metrics(m)
        fails = []
        for rule, metric, low, high in thresholds:
            bad = F.lit(False)
            if low is not None:
                bad = bad | (metrics[metric] < F.lit(low))
            if high is not None:
                bad = bad | (metrics[metric] > F.lit(high))
            fails.append(F.when(bad, F.lit(rule)))
        failed = F.filter(F.array(*fails), lambda x: x.isNotNull()) if fails else F.array().cast("array<string>")
        base = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
        return let(
            failed,
            lambda f: F.struct(
                *[m[c].alias(c) for c in COUNTS], f.alias("failed_rules"), base.alias("base_failed"), (~base & (F.size(f) == 0)).alias("kept")
            ),
        )

    # one expression holds counts and verdict, so a filter on the verdict evaluates the text once
    judged = docs.withColumn("quality", let(measures(F.col(text_col)), verdict))
    return judged.withColumns({c: F.col("quality")[c] for c in ("failed_rules", "base_failed", "kept")})


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_rules(docs).select(
        "doc_id",
        *[F.col(f"quality.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        "kept",
        F.col("quality.n_lines").alias("n_lines"),
        F.col("quality.n_stop_words").alias("n_stop_words"),
        F.col("quality.n_shouted").alias("n_shouted"),
    )


_IN = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

OP4_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT rid, i, w[i:i+7] AS win FROM t, unnest(range(1, len(w) - 6)) AS r(i) WHERE len(w) >= 8),
d AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n > 1),
c AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM d, (SELECT unnest(range(0, 8)) AS k) GROUP BY rid),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_IN}))) AS n_stop_words,
         len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) AS n_shouted
  FROM t LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND CAST(word_chars AS DOUBLE) / n_words BETWEEN 2.0 AND 14.0
         AND CAST(n_symbols AS DOUBLE) / n_words <= 0.1 AND CAST(n_stop_words AS DOUBLE) / n_words >= 0.02
         AND CAST(n_dup_lines AS DOUBLE) / n_lines <= 0.5 AND CAST(n_shouted AS DOUBLE) / n_words <= 0.5 AS kept,
       CAST(n_lines AS BIGINT) AS n_lines, CAST(n_stop_words AS BIGINT) AS n_stop_words, CAST(n_shouted AS BIGINT) AS n_shouted
FROM b
"""
