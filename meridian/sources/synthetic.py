"""Generated points: the eight demo curves, the benchmark sine and a minute grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Series, offset, and the terms (amplitude, function, speed) of each demo curve.
DEMO_CURVES = [
    ("weather_temp_c", 28.0, [(5.0, "sin", 1.0)]),
    ("weather_wind_kmh", 15.0, [(6.0, "cos", 0.8)]),
    ("weather_humidity_pct", 55.0, [(-15.0, "sin", 0.7)]),
    ("btc_usd", 88000.0, [(2500.0, "sin", 0.4), (400.0, "cos", 1.2)]),
    ("eth_usd", 3200.0, [(150.0, "sin", 0.5)]),
    ("forex_eur_USD", 1.085, [(0.004, "sin", 0.3)]),
    ("forex_eur_GBP", 0.855, [(0.0025, "cos", 0.35)]),
    ("forex_eur_JPY", 162.5, [(1.2, "sin", 0.25)]),
]
TICK_SECONDS, PHASE_STEP = 2, 0.05
BENCH_POINTS, BENCH_START = 86_400, 1_735_000_000


def demo_points(ticks: DataFrame, start: int = 0) -> DataFrame:
    """Eight points for each row of ``ticks(id)``, batch or stream (``spark.range`` or a rate source)."""
    phase = F.col("id") * PHASE_STEP

    def curve(offset: float, terms) -> Column:
        out = F.lit(offset)
        for amplitude, f, speed in terms:
            out = out + amplitude * getattr(F, f)(phase * speed)
        return out

    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("series"), curve(o, t).alias("value")) for k, (n, o, t) in enumerate(DEMO_CURVES)])
    return ticks.select("id", F.explode(rows).alias("p")).select(
        "p.series", (F.lit(start) + TICK_SECONDS * F.col("id")).alias("ts"), "p.value", (len(DEMO_CURVES) * F.col("id") + F.col("p.k")).alias("seq")
    )


def benchmark_points(spark: SparkSession, n: int = BENCH_POINTS) -> DataFrame:
    """A day at one point per second: 70 plus a slow sine of amplitude 2."""
    return spark.range(n).select(
        F.lit("benchmark").alias("series"),
        (F.lit(BENCH_START) + F.col("id")).alias("ts"),
        (70.0 + 2.0 * F.sin(2 * F.pi() * F.col("id") / 3600.0)).alias("value"),
        F.col("id").alias("seq"),
    )


def minute_grid(spark: SparkSession, series: str, start: int, end: int, base: float = 50.0, seed: int = 0) -> DataFrame:
    """A point a minute around ``base`` (within 5, two decimals), the same for the same seed."""
    noise = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(series), "ts"), 11) / float(1 << 53) - 0.5) * 10
    return spark.range(start, end + 1, 60).select(F.col("id").alias("ts")).select(
        F.lit(series).alias("series"), "ts", F.round(F.lit(base) + noise, 2).alias("value"), F.col("ts").alias("seq")
    )
