"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import line_dedup, mixing, packing, quality_rules, simhash
from meridian.llm.common import discard, materialize, n_words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null texts have no words and go."""
    return quality_rules.apply_rules(docs.select(COLUMNS)).where("kept").select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand (nearly) equal in an earlier place; a document
    that is left without a word, because others hold all of its lines, goes."""
    cleaned = line_dedup.dedup_lines(docs.select(COLUMNS))
    emptied = (F.col("n_repeated") + F.col("n_near") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _with_length(cleaned.where(~F.coalesce(emptied, F.lit(False))))


def _row_hash(docs: DataFrame):
    return F.xxhash64(*[f(c) for c in COLUMNS for f in (F.isnull, F.col)])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash fingerprints within 3 bits or a Jaccard similarity of
    0.8 or more, both on five words. It is the one with the smallest id; those without id come last.

    A row goes by a hash of all of it, so different rows of one id, or without id, are documents
    apart, and rows equal in every column are one document.
    """
    named = docs.select(COLUMNS).withColumn("_node", _row_hash(docs))
    groups = simhash.similar_documents(named, "_node")
    place = F.struct(F.isnull("doc_id"), "doc_id", "_node")
    first = named.select("_node", "doc_id").join(groups, "_node").groupBy("component_id").agg(F.min(place).alias("p")).select("p._node")
    return named.join(first, "_node", "left_semi").dropDuplicates(["_node"]).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, shard by shard in the shuffled order; of a
    source's last document the mix may take only leading words.

    A text comes back by the hash of its whole row, so only rows equal in every column share one.
    """
    known = docs.select(COLUMNS).withColumn("_hash", _row_hash(docs))
    mixed = mixing.mix(known, carry=["_hash"]).select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_row"), F.explode("pieces").alias("_piece"))
    texts = known.withColumn("_size", n_words(F.col("text"))).where("_size > 0").dropDuplicates(["doc_id", "_hash"])
    taken = texts.join(mixed, texts["doc_id"].eqNullSafe(mixed["_id"]) & (texts["_hash"] == mixed["_row"]))
    words = F.col("_piece.words")
    text = F.when(words == F.col("_size"), F.col("text")).otherwise(mixing.take_words(F.col("text"), words))
    place = mixing.shuffle_key(0, F.col("_piece.shard"), F.col("doc_id"), F.col("_hash"), F.col("_piece.copy"))
    dealt = taken.withColumn("text", text).withColumn("_place", place).repartition("_piece.shard")
    return _with_length(dealt.sortWithinPartitions("_piece.shard", "_place"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every word of every document goes in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SimHash and the seeded order of the mix are not SQL; a plain Python version is in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
