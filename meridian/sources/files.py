"""Record files of fixed width, read where they lie: write-ahead logs, rollup files, chunk files, chunk indexes.

A file is a row ``(series, file_name, content)`` of Spark's ``binaryFile`` source; its records are cut out with built-in
functions. Folders are named after their series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions.scalar import bits_float
from meridian.operators.codec import unframe

# Bytes of a log record (time, value) and of a rollup record (start, avg, min, max, count), all big-endian.
LOG_RECORD, ROLLUP_RECORD = 16, 36


def read_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files below ``path`` whose name matches the glob ``pattern``, one row each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("series"), F.element_at(parts, -1).alias("file_name"), "content")


def _unsigned(at: Column, width: int) -> Column:
    """Big-endian number of ``width`` bytes at the 0-based place ``at`` of content."""
    return F.conv(F.hex(F.substring(F.col("content"), at + 1, F.lit(width))), 16, 10).cast("decimal(20,0)")


def _double(at: Column) -> Column:
    raw = _unsigned(at, 8)
    top = F.lit(str(1 << 63)).cast("decimal(20,0)")
    return bits_float(F.when(raw >= top, raw - top - top).otherwise(raw).cast("long"))


def _records(files: DataFrame, width: int) -> DataFrame:
    n = F.floor(F.octet_length("content") / width).cast("int")
    return files.where(n > 0).withColumn("nth", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("at", F.col("nth") * width)


def log_points(files: DataFrame) -> DataFrame:
    """Points of write-ahead logs in order; a torn last record is dropped, times beyond 2^63 - 1 are null."""
    r = _records(files, LOG_RECORD)
    return r.select("series", _unsigned(F.col("at"), 8).try_cast("long").alias("ts"), _double(F.col("at") + 8).alias("value"), F.col("nth").cast("long").alias("seq"))


def rollup_records(files: DataFrame) -> DataFrame:
    """Records of rollup files. A file that is not a whole number of records counts as having none."""
    r = _records(files.where(F.octet_length("content") % ROLLUP_RECORD == 0), ROLLUP_RECORD)
    number = lambda k: _double(F.col("at") + 8 * k)
    return r.select(
        "series", _unsigned(F.col("at"), 8).try_cast("long").alias("window_start"), number(1).alias("avg"), number(2).alias("min"), number(3).alias("max"),
        _unsigned(F.col("at") + 32, 4).cast("long").alias("count"),
    )


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """Encoded chunks below ``path`` with ``error`` for those that cannot be read; ``codec.decode`` gives the points of the sound ones."""
    return unframe(read_files(spark, path, "chunk_*.dat"))


def chunk_headers(chunks: DataFrame) -> DataFrame:
    """Index of the sound chunks, ordered by their start: what an index file would hold."""
    good = chunks.where("error is null or error = 'bad checksum'")
    name = F.format_string("chunk_%04d.dat", "chunk")
    return good.select("series", name.alias("file_name"), "start_time", "end_time", F.col("count").alias("point_count")).orderBy("series", "start_time")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index files (name, start, end, count per line, no header); a malformed line fails the read."""
    schema = "file_name string, start_time long, end_time long, point_count long"
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path)
