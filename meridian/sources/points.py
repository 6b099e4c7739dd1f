"""Point sources: event tables, Parquet point tables, bag unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.model import DAY, POINTS

#: Whole seconds since the epoch of a TIMESTAMP_NTZ: no session time zone is involved.
EPOCH_SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {0})"


def event_points(spark: SparkSession, sf_dir: str, series: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Points of the ``events`` table: the event type is the series, the event id the order of arrival.

    Series and time bounds are put on the stored columns too, so the scan skips row groups.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stamp = "TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {0})"
    if series is not None:
        events = events.where(F.col("event_type") == series)
    if start is not None:
        events = events.where(F.expr(f"ts >= {stamp.format(start)}"))
    if end is not None:
        events = events.where(F.expr(f"ts < {stamp.format(end + 1)}"))
    return events.select(
        F.col("event_type").alias("series"),
        F.expr(EPOCH_SECONDS.format("ts")).alias("ts"),
        F.col("value"),
        F.col("event_id").alias("seq"),
    ).where("series is not null and ts is not null and value is not null")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """A point table written by ``write_points``, with its ``day``, so that ``scan`` prunes days."""
    return spark.read.parquet(path).select([f.name for f in POINTS] + ["day"])


def write_points(points: DataFrame, path: str, mode: str = "append", batch: int | None = None) -> None:
    """Add points as Parquet by day, clustered by series: range queries prune days, and the sort lets row
    groups of other series be skipped without a folder per series. Rows are dealt by ranges, so a
    series with a third of a day's points is many tasks. Points of a numbered ``batch`` go to folders of its own,
    which a repeated write of the same batch replaces: a retry stores nothing twice."""
    rows = with_day(points).repartitionByRange("day", "series", "ts").sortWithinPartitions("day", "series", "ts")
    if batch is None:
        rows.withColumn("batch", F.lit(-1).cast("long")).write.mode(mode).partitionBy("day", "batch").parquet(path)
    else:
        rows = rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        rows.partitionBy("day", "batch").parquet(path)


def with_day(points: DataFrame) -> DataFrame:
    """``points`` with the number of the day that their table is partitioned by."""
    return points.select([f.name for f in POINTS]).withColumn("day", F.floor(F.col("ts") / DAY).cast("int"))


def like(fresh: DataFrame, points: DataFrame) -> DataFrame:
    """``fresh`` points with the columns of a table of points."""
    return (with_day(fresh) if "day" in points.columns else fresh).select(points.columns)


def scan(points: DataFrame, series: str, start: int, end: int) -> DataFrame:
    """Raw points of one series with ``start <= ts <= end``, both ends included, duplicates kept."""
    out = points.where((F.col("series") == series) & F.col("ts").between(start, end))
    if "day" in points.columns:
        out = out.where(F.col("day").between(start // DAY, end // DAY))
    return out


def union_all(*parts: DataFrame) -> DataFrame:
    """Bag union by column name: committed chunks and fresh points, nothing deduplicated."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def insert_missing(points: DataFrame, fresh: DataFrame) -> DataFrame:
    """``points`` and those of ``fresh`` whose (series, ts) is not there yet."""
    return points.unionByName(like(fresh.join(points.select("series", "ts"), ["series", "ts"], "left_anti"), points))
