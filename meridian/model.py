"""Data model: schemas, constants and validation rules of the time-series engine.

A point is (series, ts, value, seq): seconds since the epoch, a double, and the order of arrival. Points are
append-only, may repeat, and have no key. A rollup record is the avg, min, max and count of the
values of one series in one window.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType(
    [
        T.StructField("series", T.StringType(), False),
        T.StructField("ts", T.LongType(), False),
        T.StructField("value", T.DoubleType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)
ROLLUP = T.StructType(
    [
        T.StructField("series", T.StringType(), False),
        T.StructField("window_start", T.LongType(), False),
        T.StructField("avg", T.DoubleType(), True),
        T.StructField("min", T.DoubleType(), True),
        T.StructField("max", T.DoubleType(), True),
        T.StructField("count", T.LongType(), False),
    ]
)
RULES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("series", T.StringType(), False),
        T.StructField("operator", T.StringType(), False),
        T.StructField("threshold", T.DoubleType(), False),
        T.StructField("enabled", T.BooleanType(), False),
        T.StructField("created_at", T.LongType(), False),
    ]
)

HOUR, DAY = 3600, 86400

# Limits and thresholds that results depend on.
MAX_POINTS_PER_CHUNK = 10_000
MAX_CHUNK_SECONDS = 7_200
HOURLY_FROM_SECONDS = 10_800
DAILY_FROM_SECONDS = 172_800
ALERT_COOLDOWN_SECONDS = 5
TRIGGER_HISTORY = 100
TAIL_LINES = 200
OPERATORS = (">", "<", ">=", "<=", "==")

#: The whole name, and nothing after it: ``$`` would let a final line break through.
SERIES_NAME = r"^[a-zA-Z0-9_]+\z"


def valid_series(series: Column) -> Column:
    return F.coalesce(series.rlike(SERIES_NAME), F.lit(False))


def floor_to(ts: Column, width: int) -> Column:
    """Start of the window of ``width`` seconds that holds a non-negative ``ts``; no time zone is involved."""
    return ts - ts % width


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    """The threshold predicate, its operator chosen row by row. NaN satisfies nothing, not even ``==``."""
    holds = (
        F.when(operator == ">", value > threshold)
        .when(operator == "<", value < threshold)
        .when(operator == ">=", value >= threshold)
        .when(operator == "<=", value <= threshold)
        .when(operator == "==", value == threshold)
        .otherwise(F.lit(False))
    )
    return ~F.isnan(value) & ~F.isnan(threshold) & holds


def check_range(start: int, end: int) -> None:
    """The serving layer refuses empty and reversed ranges; the planner itself takes any."""
    if start >= end:
        raise ValueError("start must be less than end")
