"""Streaming jobs: ingest, rollups, tail and alerts over unbounded points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from meridian.model import ALERT_COOLDOWN_SECONDS, DAY, HOUR, POINTS
from meridian.operators.alerts import matches
from meridian.operators.rollup import _extremes
from meridian.sources.points import write_points


def point_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Points as they arrive as Parquet files in a folder."""
    reader = spark.readStream.schema(POINTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def ingest(points: DataFrame, path: str, checkpoint: str, fan_out=None) -> StreamingQuery:
    """Add points to a point table, then hand the batch to ``fan_out(batch, id)``; the checkpoint is the write-ahead log.

    A batch that is run again after a failure replaces its own part of the table; ``fan_out`` then gets the
    same rows with the same id again and must take it as a key.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        write_points(batch, path, batch=batch_id)
        if fan_out is not None:
            fan_out(batch, batch_id)
        batch.unpersist()

    return points.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watermark_rollup(points: DataFrame, width: int = HOUR, late: str = "1 hour") -> DataFrame:
    """Rollup that closes a window when the watermark passes it; later points of it are dropped. This is the form to
    run at scale: partial aggregation, state only for open windows."""
    low, high = _extremes(F.col("value"))
    timed = points.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return (
        timed.groupBy("series", F.window("at", f"{width} seconds").alias("w"))
        .agg((F.sum("value") / F.count("*")).alias("avg"), low.alias("min"), high.alias("max"), F.count("*").alias("count"))
        .select("series", F.unix_timestamp("w.start").alias("window_start"), "avg", "min", "max", "count")
    )


class ArrivalRollup(StatefulProcessor):
    """Closes a window of a series when a point of another window arrives, and a day when its last hour closes as the
    24th record of it. Rows are hourly (tier 'hourly') and daily (tier 'daily') records."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "window_start long, sum double, low double, high double, n long")
        self.day = handle.getValueState("day", "day long, records long, weighted double, low double, high double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows).sort_values("seq")
        state = self.open.get() if self.open.exists() else None
        day = tuple(self.day.get()) if self.day.exists() else None
        start, total, low, high, n = state if state is not None else (None, 0.0, 0.0, 0.0, 0)
        out = []
        for ts, value in zip(pdf["ts"].tolist(), pdf["value"].tolist(), strict=True):
            window = ts - ts % HOUR
            if window != start:
                if start is not None:
                    out.append((key[0], "hourly", start, total / n, low, high, n))
                    day = self._add(day, start, total / n, low, high, n)
                    if start % DAY == DAY - HOUR and day[1] == 24:
                        out.append((key[0], "daily", day[0], day[2] / day[5], day[3], day[4], day[5]))
                start, total, low, high, n = window, 0.0, float("inf"), float("-inf"), 0
            total, n = total + value, n + 1
            low, high = (value if value < low else low), (value if value > high else high)
        self.open.update((start, total, low, high, n))
        if day is not None:
            self.day.update(day)
        yield pd.DataFrame(out, columns=["series", "tier", "window_start", "avg", "min", "max", "count"])

    @staticmethod
    def _add(day, start, avg, low, high, n):
        if day is None or day[0] != start - start % DAY:
            day = (start - start % DAY, 0, 0.0, float("inf"), float("-inf"), 0)
        return (day[0], day[1] + 1, day[2] + avg * n, min(day[3], low), max(day[4], high), day[5] + n)

    def close(self) -> None:
        pass


def arrival_rollup(points: DataFrame) -> DataFrame:
    """The data-driven rollup as a stream; state is one open window and one day per series."""
    return points.groupBy("series").transformWithStateInPandas(
        statefulProcessor=ArrivalRollup(),
        outputStructType="series string, tier string, window_start long, avg double, min double, max double, count long",
        outputMode="append",
        timeMode="none",
    )


TIERS = ["series", "tier", "window_start", "avg", "min", "max", "count"]


def store_tiers(points: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add every hourly and daily record to a table when its window closes. State and table follow one checkpoint:
    a batch that is run again replaces its own records."""

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(TIERS).withColumn("batch", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tier", "batch").parquet(path)

    stream = arrival_rollup(points).writeStream.outputMode("append").foreachBatch(store)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_tiers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The hourly and the daily records that ``store_tiers`` wrote, as the planner takes them."""
    schema = "series string, window_start long, avg double, min double, max double, count long, tier string, batch long"
    stored = spark.read.schema(schema).parquet(path)
    return tuple(stored.where(F.col("tier") == t).drop("tier", "batch") for t in ("hourly", "daily"))


def tail_many(points: DataFrame, subscribers: DataFrame) -> DataFrame:
    """What each of many subscribers ``(subscriber, series)`` follows: a stream-static join on the series."""
    return points.join(subscribers, "series").select("subscriber", "series", "ts", "value")


def tail(points: DataFrame, series: str) -> DataFrame:
    """Points of one series from now on: a filter on the stream."""
    return points.where(F.col("series") == series).select("ts", "value")


class Cooldown(StatefulProcessor):
    """Lets a match through unless one of its rule fired less than ``seconds`` before."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows).sort_values("seq")
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for ts in pdf["ts"].tolist():
            keep.append(last is None or ts - last >= self.seconds)
            last = ts if keep[-1] else last
        self.last.update((last,))
        yield pdf[keep]

    def close(self) -> None:
        pass


def alert_stream(points: DataFrame, rules: DataFrame, seconds: int = ALERT_COOLDOWN_SECONDS) -> DataFrame:
    """Alerts as points arrive: a stream-static join with the rules, then the cooldown as state per rule."""
    found = matches(points, rules).select("rule_id", "series", "ts", "value", "seq", "operator", "threshold")
    return found.groupBy("rule_id").transformWithStateInPandas(
        statefulProcessor=Cooldown(seconds),
        outputStructType=found.schema,
        outputMode="append",
        timeMode="none",
    )
