"""Catalog: series, totals, latest points, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names that lists of series always show.
DEFAULT_SERIES = ["engine_temp", "cpu_usage", "mem_alloc"]


def series_catalog(points: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Name, number of points, bytes on disk and time of the latest point of each series, by name.

    ``sizes(series, bytes)`` gives the bytes; without it they are zero.
    """
    meta = points.groupBy(F.col("series").alias("name")).agg(F.count("*").alias("point_count"), F.max("ts").alias("last_updated"))
    if sizes is None:
        meta = meta.withColumn("disk_bytes", F.lit(0).cast("long"))
    else:
        meta = meta.join(sizes.select(F.col("series").alias("name"), F.col("bytes").alias("disk_bytes")), "name", "left").fillna(0, ["disk_bytes"])
    return meta.select("name", "point_count", "disk_bytes", "last_updated").orderBy("name")


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of every file below ``path`` from the file listing; no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), "modificationTime")


def totals(catalog: DataFrame) -> DataFrame:
    """Number of series and their bytes."""
    return catalog.agg(F.count("*").alias("series_count"), F.coalesce(F.sum("disk_bytes"), F.lit(0)).alias("total_disk_bytes"))


def latest_points(points: DataFrame) -> DataFrame:
    """The point of each series that arrived last, by one aggregation."""
    last = points.groupBy("series").agg(F.max_by(F.struct("ts", "value", "seq"), "seq").alias("p"))
    return last.select("series", "p.ts", "p.value", "p.seq")


def series_names(*tables: DataFrame) -> DataFrame:
    """Sorted set of the series of several tables."""
    out = tables[0].select("series")
    for t in tables[1:]:
        out = out.unionByName(t.select("series"))
    return out.distinct().orderBy("series")


def name_options(points: DataFrame) -> DataFrame:
    """Names for a selection list: those stored and the default ones."""
    extra = points.sparkSession.createDataFrame([(x,) for x in DEFAULT_SERIES], "series string")
    return series_names(points, extra)


def tail(points: DataFrame, series: str, n: int) -> DataFrame:
    """The ``n`` points of a series that arrived last, newest first."""
    return points.where(F.col("series") == series).orderBy(F.desc("seq")).limit(n)


def chart(points: DataFrame, value_col: str = "value", at_col: str = "ts") -> DataFrame:
    """``points`` with both axes scaled to 0..1 of their range (a range of zero counts as 1)."""
    ends = points.agg(*[f(c).alias(f"{p}_{c}") for c in (value_col, at_col) for p, f in (("lo", F.min), ("hi", F.max))])

    def scaled(c: str):
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        return (F.col(c) - F.col(f"lo_{c}")) / F.when(span == 0, F.lit(1)).otherwise(span)

    joined = points.join(F.broadcast(ends))  # one row
    return joined.withColumns({"y": scaled(value_col), "x": scaled(at_col)}).drop(*ends.columns)


def axis_ticks(points: DataFrame, at_col: str = "ts") -> DataFrame:
    """First, middle and last row of a chart by its axis; made for what one chart shows, which is sorted whole."""
    numbered = points.withColumns({"_row": F.row_number().over(Window.orderBy(at_col)) - 1, "_rows": F.count("*").over(Window.partitionBy())})
    picks = (F.lit(0), F.floor((F.col("_rows") - 1) / 2), F.col("_rows") - 1)
    return numbered.where(F.col("_row").isin(*picks)).drop("_row", "_rows")
