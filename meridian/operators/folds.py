"""Operators whose next state depends on earlier decisions: chunk assignment and alert cooldown.

Rows of a key are sorted by Spark and run through in order; the fold keeps a few numbers and hands
rows on batch by batch, so a long series needs no more memory than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.model import ALERT_COOLDOWN_SECONDS, MAX_CHUNK_SECONDS, MAX_POINTS_PER_CHUNK
from meridian.operators.rollup import STRETCH


def assign_chunks(points: DataFrame, max_points: int = MAX_POINTS_PER_CHUNK, max_seconds: int = MAX_CHUNK_SECONDS) -> DataFrame:
    """Add ``chunk`` (0, 1, ... per series): a chunk closes after the point that makes it ``max_points`` long, or that lies
    ``max_seconds`` or more after its first one; that point still belongs to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, first, n, chunk = None, 0, 0, 0
        for batch in batches:
            names, ts = batch.column("series").to_pylist(), batch.column("ts").to_numpy()
            out = np.empty(len(ts), np.int64)
            for i, (name, t) in enumerate(zip(names, ts.tolist(), strict=True)):
                if name != series:
                    series, first, n, chunk = name, t, 0, 0
                elif n == 0:
                    first = t
                out[i] = chunk
                n += 1
                if n >= max_points or (n >= 2 and t - first >= max_seconds):
                    chunk, n = chunk + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "chunk"])

    rows = points.select("series", "ts", "value", "seq").repartition("series").sortWithinPartitions("series", "seq")
    return rows.mapInArrow(run, "series string, ts long, value double, seq long, chunk long")


def chunk_index(chunked: DataFrame) -> DataFrame:
    """One row per chunk: first and last point by arrival, least and greatest time, number of points."""
    return chunked.groupBy("series", "chunk").agg(
        F.min_by("ts", "seq").alias("start_time"),
        F.max_by("ts", "seq").alias("end_time"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
        F.count("*").alias("point_count"),
    )


def chunks_overlapping(index: DataFrame, start: int, end: int) -> DataFrame:
    """Chunks that may hold points of the closed range. Times are the true extremes, so points that arrived
    late are not pruned away."""
    return index.where((F.col("max_ts") >= start) & (F.col("min_ts") <= end))


def cooldown(matches: DataFrame, seconds: int = ALERT_COOLDOWN_SECONDS) -> DataFrame:
    """The ``matches(rule_id, ts, seq, ...)`` that fire: one is suppressed within ``seconds`` after the last one of its rule that
    fired, in order of ``seq`` with ts as the clock.

    A match at least ``seconds`` after everything before it fires for certain, so each rule falls
    into independent bursts there, and only bursts are run through in order. Where bursts begin is found
    stretch by stretch of ``seq``: each takes over the greatest time and the number of bursts of the ones before it.
    """
    columns = matches.columns
    rows = matches.withColumn("_stretch", F.floor(F.col("seq") / STRETCH))
    earlier = Window.partitionBy("rule_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("rule_id", "_stretch").orderBy("seq")
    ends = rows.groupBy("rule_id", "_stretch").agg(F.max("ts").alias("_top"))
    ends = ends.select("rule_id", "_stretch", F.max("_top").over(earlier).alias("_carried"))
    latest = F.greatest(F.max("ts").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried"))
    marked = rows.join(ends, ["rule_id", "_stretch"]).withColumn("_new", F.when(F.col("ts") - latest < seconds, 0).otherwise(1))
    counts = marked.groupBy("rule_id", "_stretch").agg(F.sum("_new").alias("_n"))
    counts = counts.select("rule_id", "_stretch", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    bursts = marked.join(counts, ["rule_id", "_stretch"]).withColumn("_burst", F.col("_before") + F.sum("_new").over(inside))
    bursts = bursts.select(*columns, "_new", "_burst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        burst, last = None, 0
        for batch in batches:
            keep = []
            keys = zip(batch.column("rule_id").to_pylist(), batch.column("_burst").to_pylist(), strict=True)
            for key, t in zip(keys, batch.column("ts").to_pylist(), strict=True):
                fires = key != burst or t - last >= seconds
                if fires:
                    burst, last = key, t
                keep.append(fires)
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = bursts.repartition("rule_id", "_burst").sortWithinPartitions("rule_id", "_burst", "seq")
    return rows.mapInArrow(run, rows.schema).drop("_new", "_burst")
