"""The line protocol: WRITE, QUERY, TAIL and BENCHMARK commands as a DataFrame of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.scalar import parse_f64, parse_u64
from meridian.model import valid_series

# The exact answers of the protocol.
OK = "OK"
END = "END"
WRITE_USAGE = "ERR usage: WRITE <series> <timestamp> <value>"
WRITE_SERIES = "ERR invalid series name: use [a-zA-Z0-9_]"
WRITE_TIME = "ERR invalid timestamp: not an integer"
WRITE_VALUE = "ERR invalid value: not a number"
QUERY_USAGE = "ERR usage: QUERY <series> <start_ts> <end_ts>"
QUERY_SERIES = "ERR invalid series name"
QUERY_TIME = "ERR invalid timestamp"
QUERY_RANGE = "ERR start must be less than end"
TAIL_USAGE = "ERR usage: TAIL <series>"


def _parts(line: Column) -> Column:
    return F.filter(F.split(line, r"(?U)\s+"), lambda x: x != "")


def parse_commands(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Add to each non-blank line its verb, arguments, and ``error`` (null if the command is valid).

    Checks run in the order arity, series, timestamps, value or range; the first that fails
    names the error. The verb is case-insensitive; an unknown one is answered as typed.
    """
    df = lines.withColumn("parts", _parts(F.col(value_col))).where(F.size("parts") > 0)
    n = F.size("parts")
    arg = lambda i: F.get("parts", F.lit(i))
    verb = F.upper(arg(0))
    first, second = parse_u64(arg(2)), parse_u64(arg(3))
    number = parse_f64(arg(3))
    write = (
        F.when(n != 4, WRITE_USAGE)
        .when(~valid_series(arg(1)), WRITE_SERIES)
        .when(first.isNull(), WRITE_TIME)
        .when(number.isNull(), WRITE_VALUE)
    )
    query = (
        F.when(n != 4, QUERY_USAGE)
        .when(~valid_series(arg(1)), QUERY_SERIES)
        .when(first.isNull() | second.isNull(), QUERY_TIME)
        .when(first >= second, QUERY_RANGE)
    )
    tail = F.when(n != 2, TAIL_USAGE).when(~valid_series(arg(1)), QUERY_SERIES)
    error = (
        F.when(verb == "WRITE", write)
        .when(verb == "QUERY", query)
        .when(verb == "TAIL", tail)
        .when(verb == "BENCHMARK", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("ERR unknown command: "), arg(0)))
    )
    return df.select(
        *lines.columns,
        verb.alias("verb"),
        arg(1).alias("series"),
        F.when(verb.isin("WRITE", "QUERY"), first).alias("ts"),
        F.when(verb == "QUERY", second).alias("end_ts"),
        F.when(verb == "WRITE", number).alias("number"),
        error.alias("error"),
    )


def write_points_of(commands: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Points of the valid WRITE commands."""
    good = commands.where("verb = 'WRITE' and error is null")
    return good.select("series", "ts", F.col("number").alias("value"), F.col(seq_col).alias("seq"))


def write_answers(commands: DataFrame) -> DataFrame:
    """One answer per WRITE line and per faulty line: OK or the error."""
    return commands.where("verb = 'WRITE' or error is not null").withColumn("answer", F.coalesce("error", F.lit(OK)))


def parse_result_rows(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Result lines back to columns: two fields are a point, five a rollup record; others are dropped."""
    parts = F.split(F.col(value_col), ",")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return lines.where(F.size(parts).isin(2, 5)).select(
        F.when(F.size(parts) == 5, "rollup").otherwise("raw").alias("kind"),
        F.get(parts, F.lit(0)).try_cast("bigint").alias("at"),
        number(1).alias("value"),
        F.when(F.size(parts) == 5, number(2)).alias("min"),
        F.when(F.size(parts) == 5, number(3)).alias("max"),
        F.when(F.size(parts) == 5, F.get(parts, F.lit(4)).try_cast("bigint")).alias("count"),
    )


def classify_answers(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Kind of each incoming line: alert, ok, error, end, benchmark, row or other."""
    v = F.trim(F.col(value_col))
    kind = (
        F.when(F.startswith(v, F.lit("ALERT ")), "alert")
        .when(v == OK, "ok")
        .when(F.startswith(v, F.lit("ERR")), "error")
        .when(v == END, "end")
        .when(v.rlike(r"^[0-9]+,[0-9]+,[0-9]+\.[0-9]{2}\z"), "benchmark")
        .when(F.size(F.split(v, ",")).isin(2, 5), "row")
        .otherwise("other")
    )
    return lines.where(v != "").withColumn("kind", kind)


def parse_alert_lines(lines: DataFrame, now: Column, value_col: str = "value") -> DataFrame:
    """ALERT lines to columns; fewer than five fields give no row, a missing time means ``now``."""
    parts = F.split(F.trim(F.substring(F.col(value_col), 7, 1 << 20)), ",")
    field = lambda i: F.get(parts, F.lit(i))
    return lines.where(F.startswith(F.col(value_col), F.lit("ALERT ")) & (F.size(parts) >= 5)).select(
        field(0).alias("rule_id"),
        field(1).alias("series"),
        field(2).try_cast("double").alias("value"),
        field(3).alias("operator"),
        field(4).try_cast("double").alias("threshold"),
        F.coalesce(field(5).try_cast("bigint"), now).alias("timestamp"),
    )
