"""Alert rules over points: rule table, threshold join, cooldown, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.model import ALERT_COOLDOWN_SECONDS, OPERATORS, RULES, TRIGGER_HISTORY, compare
from meridian.operators.folds import cooldown

# The rules that exist when none were made.
DEFAULT_RULES = [("btc_usd", ">", 80000.0), ("weather_temp_c", ">", 35.0), ("cpu_usage", ">", 90.0)]


def make_rules(spark: SparkSession, rules: list[tuple[str, str, float]], created_at: int = 0, first_id: int = 0) -> DataFrame:
    """Rule table of (series, operator, threshold); ids count up from ``first_id`` and never collide."""
    for series, operator, _ in rules:
        if not series:
            raise ValueError("series name cannot be empty")
        if operator not in OPERATORS:
            raise ValueError(f'invalid operator "{operator}" (use >, <, >=, <=, ==)')
    rows = [(f"rule_{first_id + i}", s, o, float(t), True, created_at) for i, (s, o, t) in enumerate(rules)]
    return spark.createDataFrame(rows, RULES)


def seed_defaults(rules: DataFrame) -> DataFrame:
    """The rules, or the default ones if there are none."""
    return make_rules(rules.sparkSession, DEFAULT_RULES) if rules.isEmpty() else rules


def delete_rule(rules: DataFrame, rule_id: str) -> DataFrame:
    return rules.where(F.col("id") != rule_id)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of JSON files that map ids to rules; files that do not parse give none."""
    text = spark.read.text(path, wholetext=True)
    rule = "id string, series string, operator string, threshold double, enabled boolean, created_at bigint"
    parsed = text.select(F.explode(F.from_json("value", f"map<string, struct<{rule.replace(' ', ':')}>>".replace(",:", ","))).alias("key", "r"))
    return parsed.select("r.*")


def rules_json(rules: DataFrame) -> DataFrame:
    """All rules as one JSON map from id to rule."""
    r = F.struct(*[f.name for f in RULES])
    return rules.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", r))))).alias("json"))


def matches(points: DataFrame, rules: DataFrame) -> DataFrame:
    """Points that satisfy an enabled rule of their series: an equi-join on the series (Spark broadcasts the
    rules if they are small) and the rule's own comparison as a filter on the joined rows."""
    live = rules.where("enabled").select(F.col("id").alias("rule_id"), F.col("series").alias("rule_series"), "operator", "threshold")
    joined = points.join(live, F.col("series") == F.col("rule_series")).drop("rule_series")
    return joined.where(compare(F.col("value"), F.col("operator"), F.col("threshold")))


def triggers(points: DataFrame, rules: DataFrame, seconds: int = ALERT_COOLDOWN_SECONDS) -> DataFrame:
    """Alerts that fire, with the time of the point as the clock."""
    return cooldown(matches(points, rules), seconds)


def newest(fired: DataFrame, n: int = TRIGGER_HISTORY) -> DataFrame:
    """The newest ``n`` alerts, newest first, in order of (seq, rule)."""
    return fired.orderBy(F.desc("seq"), F.desc("rule_id")).limit(n)


def alert_line(number: Column, threshold: Column) -> Column:
    """Text pushed to clients; ``number`` and ``threshold`` come formatted."""
    return F.concat(F.lit("ALERT "), F.concat_ws(",", "rule_id", "series", number, "operator", threshold, F.col("ts").cast("string")))


def trigger_for_test(spark: SparkSession, series: str = "test_metric", now: int = 0) -> DataFrame:
    """The alert that a client can ask for; it is broadcast and not kept."""
    row = (f"trig_test_{now}", "rule_test", series or "test_metric", 99.9, 90.0, ">", now)
    return spark.createDataFrame([row], "id string, rule_id string, series string, value double, threshold double, operator string, timestamp long")
