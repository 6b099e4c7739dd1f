"""Helpers shared by the training-data operators: word rules, scratch tables, components."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text, in order; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words (long); null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``: a lambda variable is a binding."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share (``spark.checkpoint.dir``); where it is unset, a local one if
    the whole session is one process, else an error: executors would each write to their own disk."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        folder = tempfile.mkdtemp(prefix="meridian-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in files that outlive executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int, onto: DataFrame | None = None) -> DataFrame:
    """Like ``materialize``, dealt to ``buckets`` by ``key``: tables bucketed alike are grouped together without a shuffle.
    With ``onto``, a table bucketed alike, the rows are added to that."""
    table = onto.scratch_table if onto is not None else f"{name}_{uuid.uuid4().hex}"
    path = onto.scratch_path if onto is not None else f"{shared_dir(df.sparkSession)}/{table}"
    df.write.bucketBy(buckets, key).option("path", path).mode("append").saveAsTable(table)
    out = df.sparkSession.table(table)
    out.scratch_path, out.scratch_table = path, table
    return out


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries in this block delete their shuffle files when they end; else those stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` or ``bucketed`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    if hasattr(df, "scratch_table"):
        spark.sql(f"DROP TABLE IF EXISTS {df.scratch_table}")
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def link(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the groups of linked rows: roots hook to the least root until all links agree."""
    while True:
        ra, rb = label[a], label[b]
        open_ = ra != rb
        if not open_.any():
            return label
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        label = _roots(label)


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node of ``edges(a long, b long)``: rows (node, component).

    Alternates the large-star and small-star steps until the edges are stars. Each step
    is a minimum per node (pre-aggregated before its shuffle) joined back to the edges,
    so no group of nodes has to fit in a task, and only a count and a checksum of the edges
    reach the driver. Self-loops are dropped; no edges give no rows.
    """

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()

    e = materialize(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    seen = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        after = materialize(small.distinct(), "edges")
        now = mark(after)
        discard(e)
        e = after
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
