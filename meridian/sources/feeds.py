"""JSON sources: posted points and the three polled feeds, from text to points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.model import valid_series

WEATHER = "current struct<temperature_2m: double, wind_speed_10m: double, relative_humidity_2m: int>"
CRYPTO = "map<string, map<string, double>>"
FOREX = "rates map<string, double>"


def posted_points(df: DataFrame, now: Column | None = None, json_col: str = "json", seq_col: str = "seq") -> DataFrame:
    """Points of JSON objects {series, ts, value}; time 0 or none means ``now``; bad names or values give no row."""
    body = F.from_json(json_col, "series string, ts bigint, value double")
    when = F.coalesce(F.nullif(F.col("b.ts"), F.lit(0)), F.unix_timestamp() if now is None else now)
    out = df.select(F.col(seq_col).alias("seq"), body.alias("b")).where(valid_series(F.col("b.series")))
    return out.select("b.series", when.alias("ts"), F.coalesce("b.value", F.lit(0.0)).alias("value"), "seq").where("ts >= 0")


def weather_points(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Three points per reading ``(json, ts)``."""
    c = F.from_json(json_col, WEATHER)["current"]
    named = {
        "weather_temp_c": c["temperature_2m"],
        "weather_wind_kmh": c["wind_speed_10m"],
        "weather_humidity_pct": c["relative_humidity_2m"].cast("double"),
    }
    return _unpivot(df, named)


def crypto_points(df: DataFrame, json_col: str = "json") -> DataFrame:
    """A point per coin that the answer holds."""
    m = F.from_json(json_col, CRYPTO)
    return _unpivot(df, {f"{s}_usd": F.try_element_at(F.try_element_at(m, F.lit(coin)), F.lit("usd")) for s, coin in (("btc", "bitcoin"), ("eth", "ethereum"))})


def forex_points(df: DataFrame, json_col: str = "json") -> DataFrame:
    """A point per currency; the series is named after it."""
    rates = df.select("ts", F.explode(F.from_json(json_col, FOREX)["rates"]).alias("currency", "value"))
    return rates.select(F.concat(F.lit("forex_eur_"), "currency").alias("series"), "ts", "value").where("value is not null")


def _unpivot(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("series"), v.alias("value")) for k, v in named.items()])
    return df.select("ts", F.explode(rows).alias("p")).select("p.series", "ts", "p.value").where("value is not null")


def feed_status(series: DataFrame) -> DataFrame:
    """Which feeds are live, from the names of the catalog."""
    has = lambda *p: F.coalesce(F.bool_or(F.expr(" or ".join(f"startswith(series, '{x}')" for x in p))), F.lit(False))
    return series.agg(has("weather_").alias("weather"), has("btc_", "eth_").alias("crypto"), has("forex_").alias("forex"))
