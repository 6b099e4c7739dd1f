"""Facade: one object with the verbs of the engine over a point table and its rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions.scalar import format_g6
from meridian.model import TAIL_LINES, check_range
from meridian.operators import alerts, catalog, codec, render, rollup
from meridian.operators.folds import assign_chunks
from meridian.plans.planner import plan
from meridian.sources import lines as protocol
from meridian.sources.points import like, union_all
from meridian.sources.synthetic import benchmark_points


class Engine:
    """Time-series engine over DataFrames.

    ``points`` is the stored table. Hourly and daily records may be given as stored tables; without them
    they are derived from the points, open windows left out.
    """

    def __init__(self, points: DataFrame, hours: DataFrame | None = None, days: DataFrame | None = None, rules: DataFrame | None = None):
        self.spark: SparkSession = points.sparkSession
        self.points = points
        self.stored = (hours, days)
        self.hours = rollup.hourly(points) if hours is None else hours
        self.days = rollup.daily(self.hours) if days is None else days
        self.rules = alerts.seed_defaults(rules) if rules is not None else alerts.make_rules(self.spark, alerts.DEFAULT_RULES)

    def write(self, fresh: DataFrame) -> Engine:
        """The engine with more points; records that were given as tables stay, others are derived anew when asked for."""
        return Engine(union_all(self.points, like(fresh, self.points)), *self.stored, rules=self.rules)

    def query(self, series: str, start: int, end: int) -> DataFrame:
        check_range(start, end)
        return plan(self.points, self.hours, self.days, series, start, end)

    def query_lines(self, series: str, start: int, end: int) -> DataFrame:
        """Answer of the line protocol, its last line END (also after no rows)."""
        rows = render.result_lines(self.query(series, start, end)).select(F.lit(0).alias("last"), "at", "line")
        end_line = self.spark.createDataFrame([(1, 0, protocol.END)], "last int, at long, line string")
        return rows.unionByName(end_line).orderBy("last", "at").select("line")

    def query_json(self, series: str, start: int, end: int) -> DataFrame:
        return render.result_json(self.query(series, start, end), series)

    def export(self, series: str, start: int, end: int, path: str, form: str = "csv") -> None:
        """Write a range as CSV (also for forms that are not known) or JSON."""
        result = self.query(series, start, end)
        if form == "json":
            return render.export_json(result, path)
        first = result.select("tier").first()
        return render.export_csv(result, path, first is not None and first[0] != "raw")

    def tail(self, series: str, n: int = TAIL_LINES) -> DataFrame:
        return catalog.tail(self.points, series, n)

    def series(self) -> DataFrame:
        return catalog.series_catalog(self.points)

    def stats(self) -> DataFrame:
        return catalog.totals(self.series())

    def alerts(self) -> DataFrame:
        return alerts.newest(alerts.triggers(self.points, self.rules))

    def list_rules(self) -> DataFrame:
        return self.rules.orderBy("id")

    def add_rule(self, series: str, operator: str, threshold: float, created_at: int = 0) -> Engine:
        """The engine with one more rule; its id is one above the greatest number in use."""
        number = F.regexp_extract("id", r"^rule_([0-9]+)$", 1).try_cast("long")
        last = self.rules.agg(F.max(number)).first()[0]
        rule = alerts.make_rules(self.spark, [(series, operator, threshold)], created_at, 0 if last is None else last + 1)
        return Engine(self.points, *self.stored, rules=self.rules.unionByName(rule))

    def delete_rule(self, rule_id: str) -> Engine:
        """The engine without a rule (the default rules, if none is left)."""
        return Engine(self.points, *self.stored, rules=alerts.delete_rule(self.rules, rule_id))

    def benchmark(self) -> DataFrame:
        """``raw,compressed,ratio`` of a generated day."""
        return codec.sizes(codec.encode(assign_chunks(benchmark_points(self.spark)))).select(
            F.concat_ws(",", "raw_bytes", "compressed_bytes", F.format_string("%.2f", "ratio")).alias("line")
        )

    def run(self, commands: DataFrame) -> DataFrame:
        """Answers to a table of command lines ``(seq, value)``: (seq, line), in the order of seq: a QUERY sees the points of the
        WRITE lines before it, and a TAIL is answered by the points of the WRITE lines after it. WRITE lines
        are answered in one pass; each QUERY, TAIL or BENCHMARK is a job of its own, so this is for command
        scripts, not for bulk loads."""
        parsed = protocol.parse_commands(commands)
        out = protocol.write_answers(parsed).select("seq", F.col("answer").alias("line"))
        written = protocol.write_points_of(parsed)
        for r in parsed.where("verb in ('QUERY', 'TAIL', 'BENCHMARK') and error is null").collect():
            if r.verb == "QUERY":
                answer = self.write(written.where(F.col("seq") < r.seq)).query_lines(r.series, r.ts, r.end_ts)
            elif r.verb == "TAIL":
                answer = tail_lines(written.where((F.col("seq") > r.seq) & (F.col("series") == r.series)).orderBy("seq"))
            else:
                answer = self.benchmark()
            out = out.unionByName(answer.select(F.lit(r.seq).alias("seq"), "line"))
        return out


def tail_lines(points: DataFrame) -> DataFrame:
    """``ts,value`` lines of followed points."""
    return points.select(F.concat_ws(",", F.col("ts").cast("string"), format_g6("value")).alias("line"))
