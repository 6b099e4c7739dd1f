"""Tier planner: answer a range from raw points, hourly records or daily records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.model import DAILY_FROM_SECONDS, DAY, HOUR, HOURLY_FROM_SECONDS
from meridian.operators.rollup import overlapping, rollup
from meridian.sources.points import scan

#: Columns of every result: tier, at (time or window start), value (or avg), min, max, count.
COLUMNS = ["tier", "at", "value", "min", "max", "count"]


def width(start: int, end: int) -> int:
    """Signed 64-bit width of a range: an end beyond 2^63 wraps to a negative width and so means raw."""
    w = (end - start) & ((1 << 64) - 1)
    return w - (1 << 64) if w >> 63 else w


def _raw(points: DataFrame, tier: str = "raw") -> DataFrame:
    none = F.lit(None)
    return points.select(F.lit(tier).alias("tier"), F.col("ts").alias("at"), "value", none.cast("double").alias("min"), none.cast("double").alias("max"), none.cast("long").alias("count"))


def _records(records: DataFrame, tier: str) -> DataFrame:
    return records.select(F.lit(tier).alias("tier"), F.col("window_start").alias("at"), F.col("avg").alias("value"), "min", "max", "count")


def plan(points: DataFrame, hours: DataFrame, days: DataFrame, series: str, start: int, end: int, strict_overlap: bool = False, coverage: str = "any") -> DataFrame:
    """Rows of one series in [start, end] from the coarsest tier that fits the width and has a record there.

    A range of two days or more asks the daily records, one of three hours or more the hourly ones; without a single
    record that overlaps, the next finer tier answers, raw points last. The look for a first record stops at
    one row of a small table. ``coverage='full'`` takes a tier only if it has a record for every
    window of the range. ``strict_overlap`` tests days with the width of a day.
    """
    w = width(start, end)
    last = min(end, (1 << 63) - 1)
    for tier, records, least, step in (("daily", days, DAILY_FROM_SECONDS, DAY), ("hourly", hours, HOURLY_FROM_SECONDS, HOUR)):
        if w < least:
            continue
        found = overlapping(records.where(F.col("series") == series), start, last, step if strict_overlap else HOUR)
        if coverage == "full":
            wanted = last // step - start // step + 1
            if found.select("window_start").distinct().count() >= wanted:
                return _records(found, tier)
        elif not found.isEmpty():
            return _records(found, tier)
    return _raw(scan(points, series, start, last))


def plan_in_one(points: DataFrame, hours: DataFrame, days: DataFrame, series: str, start: int, end: int) -> DataFrame:
    """The same answer as one plan without a look-up first: all tiers that the width allows, then only the coarsest that has rows."""
    w = width(start, end)
    last = min(end, (1 << 63) - 1)
    tiers = [(0, _raw(scan(points, series, start, last)))]
    if w >= HOURLY_FROM_SECONDS:
        tiers.append((1, _records(overlapping(hours.where(F.col("series") == series), start, last), "hourly")))
    if w >= DAILY_FROM_SECONDS:
        tiers.append((2, _records(overlapping(days.where(F.col("series") == series), start, last), "daily")))
    every = None
    for rank, t in tiers:
        t = t.withColumn("rank", F.lit(rank))
        every = t if every is None else every.unionByName(t)
    best = every.agg(F.max("rank").alias("best"))
    return every.join(F.broadcast(best), F.col("rank") == F.col("best")).select(COLUMNS)  # one row


def plan_on_read(points: DataFrame, series: str, start: int, end: int) -> DataFrame:
    """Width alone decides and records are made from the raw points of the range: open windows and
    incomplete days are in, averages have two decimals."""
    rows = scan(points, series, start, end)
    w = width(start, end)
    if w < HOURLY_FROM_SECONDS:
        return _raw(rows)
    tier, step = ("daily", DAY) if w >= DAILY_FROM_SECONDS else ("hourly", HOUR)
    r = rollup(rows, step)
    return _records(r.withColumns({c: F.round(c, 2) for c in ("avg", "min", "max")}), tier)
