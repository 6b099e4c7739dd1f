"""Rollups: hourly and daily records, merged by event time or closed by order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.model import DAY, HOUR, floor_to

#: Points of a series that are ordered together; longer series are worked on in stretches.
STRETCH = 1 << 20


def _extremes(value: Column) -> tuple[Column, Column]:
    """min and max that NaN never wins; of NaN alone they are +inf and -inf."""
    real = F.when(~F.isnan(value), value)
    return F.coalesce(F.min(real), F.lit(float("inf"))), F.coalesce(F.max(real), F.lit(float("-inf")))


def lagged(rows: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Add ``name``: ``column`` of the row before, by ``seq`` in its group ``by``. Stretches of a group are ordered apart, and
    the first row of each takes the last value of the stretch before, so no group is sorted in one task."""
    rows = rows.withColumn("stretch", F.floor(F.col("seq") / STRETCH))
    local = Window.partitionBy(*by, "stretch").orderBy("seq")
    last = rows.groupBy(*by, "stretch").agg(F.max_by(F.struct(F.col(column).alias("v")), "seq").alias("last"))
    last = last.withColumn("last", F.lag("last").over(Window.partitionBy(*by).orderBy("stretch"))).where("last is not null")
    marked = rows.withColumn("_at", F.row_number().over(local)).withColumn(name, F.lag(column).over(local))
    known = marked.join(last.withColumn("_at", F.lit(1)), [*by, "stretch", "_at"], "left")
    return known.withColumn(name, F.when(F.col("_at") == 1, F.col("last.v")).otherwise(F.col(name))).select(*[c for c in rows.columns if c != "stretch"], name)


def rollup(points: DataFrame, width: int = HOUR) -> DataFrame:
    """One record per series and window, whatever the order of arrival (partial aggregation, one shuffle)."""
    low, high = _extremes(F.col("value"))
    return (
        points.groupBy("series", floor_to(F.col("ts"), width).alias("window_start"))
        .agg((F.sum("value") / F.count("*")).alias("avg"), low.alias("min"), high.alias("max"), F.count("*").alias("count"))
    )


def arrival_runs(points: DataFrame, width: int = HOUR) -> DataFrame:
    """One record per run of consecutive points of a series in the same window, in order of arrival.

    A window closes when a point of another window arrives and coming back makes a second record, so
    ``run`` numbers the records of a series; ``closed`` is false for its last one. Each stretch of
    a series is first reduced to its runs, then runs that touch over the edge of two stretches
    are joined: no series has to be sorted whole in one task.
    """
    stretch = F.floor(F.col("seq") / STRETCH)
    local = Window.partitionBy("series", "stretch").orderBy("seq")
    marked = points.select("series", "seq", "value", floor_to(F.col("ts"), width).alias("window_start"), stretch.alias("stretch"))
    marked = marked.withColumn("new", F.when(F.lag("window_start").over(local).eqNullSafe(F.col("window_start")), 0).otherwise(1))
    low, high = _extremes(F.col("value"))
    pieces = (
        marked.withColumn("part", F.sum("new").over(local))
        .groupBy("series", "stretch", "part", "window_start")
        .agg(F.min("seq").alias("first"), F.sum("value").alias("sum"), low.alias("min"), high.alias("max"), F.count("*").alias("count"))
    )
    whole = Window.partitionBy("series").orderBy("first")
    joined = pieces.withColumn("new", F.when(F.lag("window_start").over(whole).eqNullSafe(F.col("window_start")), 0).otherwise(1))
    runs = (
        joined.withColumn("run", F.sum("new").over(whole))
        .groupBy("series", "run", "window_start")
        .agg((F.sum("sum") / F.sum("count")).alias("avg"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("count").alias("count"))
    )
    return runs.withColumn("closed", F.col("run") < F.max("run").over(Window.partitionBy("series")))


def hourly(points: DataFrame, include_open: bool = False) -> DataFrame:
    """Hourly records as they are stored: closed ones only, or all after a flush."""
    runs = arrival_runs(points)
    return runs if include_open else runs.where("closed")


def daily(hours: DataFrame) -> DataFrame:
    """Daily records from hourly ones ``(series, run, window_start, ...)``: a day is written when its last hour closes and exactly
    24 hourly records of it are there by then. avg is weighted by count."""
    day = hours.withColumn("day", floor_to(F.col("window_start"), DAY))
    upto = Window.partitionBy("series", "day").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    return (
        day.withColumns(
            {
                "records": F.count("*").over(upto),
                "n": F.sum("count").over(upto),
                "weighted": F.sum(F.col("avg") * F.col("count")).over(upto),
                "low": F.min("min").over(upto),
                "high": F.max("max").over(upto),
            }
        )
        .where((F.col("window_start") == F.col("day") + DAY - HOUR) & (F.col("records") == 24))
        .select("series", F.col("day").alias("window_start"), (F.col("weighted") / F.col("n")).alias("avg"), F.col("low").alias("min"), F.col("high").alias("max"), F.col("n").alias("count"))
    )


def merge_up(records: DataFrame, width: int = DAY) -> DataFrame:
    """Records of wider windows from narrower ones, without a rule of completeness."""
    return records.groupBy("series", floor_to(F.col("window_start"), width).alias("window_start")).agg(
        (F.sum(F.col("avg") * F.col("count")) / F.sum("count")).alias("avg"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("count").alias("count")
    )


def overlapping(records: DataFrame, start: int, end: int, width: int = HOUR) -> DataFrame:
    """Records whose window overlaps [start, end]. The stored tiers are both tested with the width of an hour, so a day that
    begins more than an hour before ``start`` is left out; pass DAY for the strict test."""
    return records.where((F.col("window_start") + width > start) & (F.col("window_start") <= end))
