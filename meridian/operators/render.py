"""Result texts: protocol lines, JSON envelopes, CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.functions.scalar import format_g6, number_text

# Header rows of exports.
RAW_HEADER = "timestamp,value"
ROLLUP_HEADER = "window_start,avg,min,max,count"


def point_lines(points: DataFrame) -> DataFrame:
    """``ts,value`` per point, six significant digits, ordered by time and arrival."""
    return points.orderBy("ts", "seq").select(F.concat_ws(",", F.col("ts").cast("string"), format_g6("value")).alias("line"))


def rollup_lines(records: DataFrame) -> DataFrame:
    """``window_start,avg,min,max,count`` per record."""
    return records.orderBy("window_start").select(
        F.concat_ws(",", F.col("window_start").cast("string"), format_g6("avg"), format_g6("min"), format_g6("max"), F.col("count").cast("string")).alias("line")
    )


def result_lines(result: DataFrame) -> DataFrame:
    """Lines of a planner result (see ``plans.planner.plan``), raw or rollup by its tier."""
    rolled = F.concat_ws(",", F.col("at").cast("string"), format_g6("value"), format_g6("min"), format_g6("max"), F.col("count").cast("string"))
    raw = F.concat_ws(",", F.col("at").cast("string"), format_g6("value"))
    return result.select("at", F.when(F.col("tier") == "raw", raw).otherwise(rolled).alias("line"))


def result_json(result: DataFrame, series: str) -> DataFrame:
    """One JSON row with series, tier, points and count, full precision. Made for answers to one client:
    the points of the asked range meet in one row, by time, then by value. Numbers JSON cannot hold become null."""
    number = lambda c: F.coalesce(number_text(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))), F.lit("null"))
    raw = F.concat(F.lit('{"ts":'), F.col("at").cast("string"), F.lit(',"value":'), number("value"), F.lit("}"))
    rolled = F.concat(
        F.lit('{"window_start":'), F.col("at").cast("string"), F.lit(',"avg":'), number("value"), F.lit(',"min":'), number("min"),
        F.lit(',"max":'), number("max"), F.lit(',"count":'), F.col("count").cast("string"), F.lit("}"),
    )
    body = F.when(F.col("tier") == "raw", raw).otherwise(rolled)
    rows = result.select("tier", "at", "value", body.alias("body")).groupBy("tier").agg(F.sort_array(F.collect_list(F.struct("at", "value", "body"))).alias("b"))
    return rows.select(
        F.concat(
            F.lit('{"series":"' + series + '","tier":"'), "tier", F.lit('","points":['),
            F.array_join(F.transform("b", lambda x: x["body"]), ","), F.lit('],"count":'), F.size("b").cast("string"), F.lit("}"),
        ).alias("json")
    )


def export_csv(result: DataFrame, path: str, rollup: bool) -> None:
    """Write a planner result as CSV with the header of its tier, from all tasks."""
    cols = [F.col("at").alias("window_start" if rollup else "timestamp"), F.col("value").alias("avg" if rollup else "value")]
    result.select(*cols, *(["min", "max", "count"] if rollup else [])).write.mode("overwrite").csv(path, header=True)


def export_json(result: DataFrame, path: str) -> None:
    """Write a planner result as JSON lines."""
    result.write.mode("overwrite").json(path)


def collapsed(result: DataFrame) -> DataFrame:
    """Any result as (timestamp, value): records count as their start and average."""
    return result.select(F.col("at").alias("timestamp"), "value")


def export_name(prefix: str, series: str, start: int, end: int, form: str) -> str:
    return f"{prefix}_{series}_{start}_{end}.{form}"
