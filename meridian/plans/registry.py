"""Registered queries of the time-series engine and the SQL that states the same result.

The ``events`` table is the point table: the event type is the series, the event id the order of arrival.
Averages are compared in single precision on both sides, since sums of doubles depend on their order.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import scalar
from meridian.functions.scalar import format_g6
from meridian.model import DAY, HOUR, TAIL_LINES
from meridian.operators import alerts, catalog, codec, render, rollup
from meridian.operators.folds import assign_chunks, chunk_index, chunks_overlapping
from meridian.plans import planner
from meridian.sources import feeds, synthetic
from meridian.sources import lines as protocol
from meridian.sources.points import EPOCH_SECONDS, event_points, insert_missing, scan, union_all
from meridian.sources.shared import shared_folder
from meridian.streaming import jobs

QUERIES = {}
SQL = {}

#: Start of the events, and a range of thirty days.
T0, T1 = 1704067200, 1706659200
SERIES = "click"
RULES = [("click", ">", 90.0), ("view", "<=", 5.0), ("purchase", ">=", 400.0), ("signup", "==", 42.0), ("click", "<", 1.0), ("no_such", ">", 0.0)]
REPLAY_COOLDOWN = 3600

P = "p AS (SELECT event_type AS series, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value, event_id AS seq FROM events)"
RUNS = f"""{P},
b AS (SELECT *, ts - ts % 3600 AS w,
        CASE WHEN lag(ts - ts % 3600) OVER (PARTITION BY series ORDER BY seq) = ts - ts % 3600 THEN 0 ELSE 1 END AS chg FROM p),
r AS (SELECT *, CAST(sum(chg) OVER (PARTITION BY series ORDER BY seq) AS BIGINT) AS run FROM b),
h AS (SELECT series, run, w AS window_start, sum(value) / count(*) AS avg, min(value) AS min, max(value) AS max, count(*) AS count
      FROM r GROUP BY series, run, w),
f AS (SELECT *, run < max(run) OVER (PARTITION BY series) AS closed FROM h)"""


def _days(flag: str) -> str:
    return f"""d AS (SELECT *, window_start - window_start % 86400 AS day FROM f WHERE {flag}),
k AS (SELECT *, count(*) OVER w AS records, sum(count) OVER w AS n, sum(avg * count) OVER w AS weighted, min(min) OVER w AS low, max(max) OVER w AS high
      FROM d WINDOW w AS (PARTITION BY series, day ORDER BY run ROWS UNBOUNDED PRECEDING)),
days AS (SELECT series, day AS window_start, weighted / n AS avg, low AS min, high AS max, CAST(n AS BIGINT) AS count
         FROM k WHERE window_start = day + 82800 AND records = 24)"""


def _rules_sql() -> str:
    rows = ", ".join(f"('rule_{i}', '{s}', '{o}', {t})" for i, (s, o, t) in enumerate(RULES))
    return f"""rules(rule_id, rule_series, operator, threshold) AS (VALUES {rows}),
m AS (SELECT p.series, ts, value, seq, rule_id, operator, CAST(threshold AS DOUBLE) AS threshold FROM p JOIN rules ON series = rule_series
      WHERE CASE operator WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold WHEN '>=' THEN value >= threshold
            WHEN '<=' THEN value <= threshold ELSE value = threshold END)"""


FIRED = f"""q AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY seq) AS n FROM m),
fired AS (SELECT * FROM q WHERE n = 1 UNION ALL
  SELECT nx.* FROM (SELECT fired.rule_id, min(q.n) AS n FROM fired JOIN q ON q.rule_id = fired.rule_id AND q.n > fired.n
                    AND q.ts - fired.ts >= {REPLAY_COOLDOWN} GROUP BY fired.rule_id) AS x JOIN q AS nx ON nx.rule_id = x.rule_id AND nx.n = x.n)"""

CHUNKS = f"""{P},
q AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY seq) AS n FROM p),
c AS (SELECT series, CAST(0 AS BIGINT) AS chunk, CAST(1 AS BIGINT) AS first_n, ts AS first_ts FROM q WHERE n = 1 UNION ALL
  SELECT nx.series, x.chunk + 1, nx.n, nx.ts FROM
    (SELECT c.series, c.chunk, min(q.n) AS last_n FROM c JOIN q ON q.series = c.series AND q.n > c.first_n
     AND (q.n - c.first_n + 1 >= 10000 OR q.ts - c.first_ts >= 7200) GROUP BY c.series, c.chunk) AS x
    JOIN q AS nx ON nx.series = x.series AND nx.n = x.last_n + 1),
a AS (SELECT q.*, chunk FROM q ASOF JOIN c ON q.series = c.series AND q.n >= c.first_n)"""


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if given."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Single precision: what a sum's order changes lies far below it."""
    return df.withColumns({c: F.col(c).cast("float") for c in cols or ["avg"]})


# -- scans -------------------------------------------------------------------------------------


@query("raw_range_scan", f"WITH {P} SELECT ts, value FROM p WHERE series = '{SERIES}' AND ts BETWEEN {T0} AND {T0 + 7 * DAY}")
def raw_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    points = event_points(spark, sf, SERIES, T0, T0 + 7 * DAY)
    return scan(points, SERIES, T0, T0 + 7 * DAY).select("ts", "value")


@query("union_of_parts", f"WITH {P} SELECT series, ts, value, seq FROM p WHERE ts < {T0 + DAY} UNION ALL SELECT series, ts, value, seq FROM p WHERE ts BETWEEN {T0} AND {T0 + 2 * DAY}")
def union_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    return union_all(event_points(spark, sf, end=T0 + DAY - 1), event_points(spark, sf, start=T0, end=T0 + 2 * DAY))


@query("live_last_hour", f"WITH {P} SELECT series, ts, value FROM p WHERE ts >= (SELECT max(ts) FROM p) - 3600")
def live_last_hour(spark: SparkSession, sf: str) -> DataFrame:
    points = event_points(spark, sf)
    newest = points.agg((F.max("ts") - HOUR).alias("least"))
    return points.join(F.broadcast(newest), F.col("ts") >= F.col("least")).select("series", "ts", "value")  # one row


@query("points_missing_from_grid", f"""WITH {P}, g AS (SELECT '{SERIES}' AS series, CAST(unnest(range({T0}, {T0 + DAY} + 1, 60)) AS BIGINT) AS ts)
SELECT count(*) AS points, count(*) FILTER (is_new) AS inserted FROM (
  SELECT false AS is_new FROM p UNION ALL SELECT true FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.series = g.series AND p.ts = g.ts))""")
def points_missing_from_grid(spark: SparkSession, sf: str) -> DataFrame:
    stored = event_points(spark, sf).withColumn("is_new", F.lit(False))
    grid = synthetic.minute_grid(spark, SERIES, T0, T0 + DAY).withColumn("is_new", F.lit(True))
    return insert_missing(stored, grid).agg(F.count("*").alias("points"), F.count_if("is_new").alias("inserted"))


# -- rollups -----------------------------------------------------------------------------------


def _rollup_sql(width: int) -> str:
    return f"""WITH {P} SELECT series, ts - ts % {width} AS window_start, CAST(sum(value) / count(*) AS FLOAT) AS avg, min(value) AS min, max(value) AS max,
count(*) AS count FROM p GROUP BY ALL"""


@query("hourly_rollup", _rollup_sql(HOUR))
def hourly_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.rollup(event_points(spark, sf), HOUR))


@query("daily_rollup", _rollup_sql(DAY))
def daily_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.rollup(event_points(spark, sf), DAY))


@query("hourly_rollup_runs", f"WITH {RUNS} SELECT series, run, window_start, CAST(avg AS FLOAT) AS avg, min, max, count, closed FROM f")
def hourly_rollup_runs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.arrival_runs(event_points(spark, sf)))


@query("hourly_closed", f"WITH {RUNS} SELECT series, window_start, CAST(avg AS FLOAT) AS avg, min, max, count FROM f WHERE closed")
def hourly_closed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.hourly(event_points(spark, sf))).drop("run", "closed")


@query("hourly_flushed", f"WITH {RUNS} SELECT series, window_start, CAST(avg AS FLOAT) AS avg, min, max, count FROM f")
def hourly_flushed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.hourly(event_points(spark, sf), include_open=True)).drop("run", "closed")


@query("daily_complete_days", f"WITH {RUNS}, {_days('closed')} SELECT series, window_start, CAST(avg AS FLOAT) AS avg, min, max, count FROM days")
def daily_complete_days(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.daily(rollup.hourly(event_points(spark, sf))))


@query("daily_complete_flushed", f"WITH {RUNS}, {_days('true')} SELECT series, window_start, CAST(avg AS FLOAT) AS avg, min, max, count FROM days")
def daily_complete_flushed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.daily(rollup.hourly(event_points(spark, sf), include_open=True)))


@query("daily_from_hourly", f"""WITH {RUNS} SELECT series, window_start - window_start % 86400 AS window_start, CAST(sum(avg * count) / sum(count) AS FLOAT) AS avg,
min(min) AS min, max(max) AS max, CAST(sum(count) AS BIGINT) AS count FROM f GROUP BY ALL""")
def daily_from_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.merge_up(rollup.hourly(event_points(spark, sf), include_open=True)))


@query("hours_of_day", f"WITH {RUNS} SELECT series, window_start, CAST(avg AS FLOAT) AS avg, count FROM f WHERE closed AND window_start >= {T0 + 3 * DAY} AND window_start < {T0 + 4 * DAY}")
def hours_of_day(spark: SparkSession, sf: str) -> DataFrame:
    hours = rollup.hourly(event_points(spark, sf))
    return rounded(hours.where((F.col("window_start") >= T0 + 3 * DAY) & (F.col("window_start") < T0 + 4 * DAY))).select("series", "window_start", "avg", "count")


@query("overlap_hourly", f"WITH {RUNS} SELECT series, window_start, count FROM f WHERE closed AND window_start + 3600 > {T0 + 5000} AND window_start <= {T0 + 90000}")
def overlap_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.overlapping(rollup.hourly(event_points(spark, sf)), T0 + 5000, T0 + 90000).select("series", "window_start", "count")


@query("overlap_daily", f"""WITH {RUNS}, {_days('true')} SELECT series, window_start, count, 'hour' AS test FROM days WHERE window_start + 3600 > {T0 + 2 * DAY + 3600} AND window_start <= {T1}
UNION ALL SELECT series, window_start, count, 'day' FROM days WHERE window_start + 86400 > {T0 + 2 * DAY + 3600} AND window_start <= {T1}""")
def overlap_daily(spark: SparkSession, sf: str) -> DataFrame:
    days = rollup.daily(rollup.hourly(event_points(spark, sf), include_open=True))
    tests = [rollup.overlapping(days, T0 + 2 * DAY + 3600, T1, w).withColumn("test", F.lit(t)) for w, t in ((HOUR, "hour"), (DAY, "day"))]
    return union_all(*tests).select("series", "window_start", "count", "test")


# -- planner -----------------------------------------------------------------------------------


def _plan(spark: SparkSession, sf: str, start: int, end: int, f=planner.plan) -> DataFrame:
    points = event_points(spark, sf)
    hours = rollup.hourly(points)
    return f(points, hours, rollup.daily(hours), SERIES, start, end)


def _plan_sql(start: int, end: int, columns: str = "min, max, count") -> str:
    w = end - start
    columns = f", {columns}" if columns else ""
    return f"""WITH {RUNS}, {_days('closed')},
u AS (
  SELECT 0 AS rank, 'raw' AS tier, ts AS at_time, value, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS BIGINT) AS count
  FROM p WHERE series = '{SERIES}' AND ts BETWEEN {start} AND {end}
  UNION ALL SELECT 1, 'hourly', window_start, avg, min, max, count FROM f WHERE closed AND {w} >= 10800 AND series = '{SERIES}' AND window_start + 3600 > {start} AND window_start <= {end}
  UNION ALL SELECT 2, 'daily', window_start, avg, min, max, count FROM days WHERE {w} >= 172800 AND series = '{SERIES}' AND window_start + 3600 > {start} AND window_start <= {end})
SELECT tier, at_time AS "at", CAST(value AS FLOAT) AS value{columns} FROM u WHERE rank = (SELECT max(rank) FROM u)"""


ALL, RAW = ("tier", "at", "value", "min", "max", "count"), ("tier", "at", "value")  # raw points have no extremes

for _name, _start, _end, _columns in [
    ("planner_raw", T0, T0 + 10799, RAW),
    ("planner_hourly_at_threshold", T0, T0 + 10800, ALL),
    ("planner_hourly", T0, T0 + 172799, ALL),
    ("planner_daily", T0, T1, ALL),
    ("planner_daily_at_threshold", T0 + 4 * DAY, T0 + 6 * DAY, ALL),
    ("planner_after_the_end", T1 + 60 * DAY, T1 + 90 * DAY, RAW),
]:
    query(_name, _plan_sql(_start, _end, ", ".join(_columns[3:])))(
        lambda spark, sf, a=_start, b=_end, columns=_columns: rounded(_plan(spark, sf, a, b), "value").select(*columns)
    )


@query("planner_fallback", _plan_sql(T0, T1))
def planner_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_plan(spark, sf, T0, T1), "value")


@query("planner_stored_tiers", _plan_sql(T0 + 1800, T0 + 172000))
def planner_stored_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """The planner over hourly and daily records that a stream has stored."""
    folder = shared_folder(spark, "tiers")
    with _rocks(spark):
        jobs.store_tiers(_event_stream(spark, sf), f"{folder}/records", f"{folder}/checkpoint").awaitTermination()
    hours, days = jobs.read_tiers(spark, f"{folder}/records")
    return rounded(planner.plan(event_points(spark, sf), hours, days, SERIES, T0 + 1800, T0 + 172000), "value")


@query("planner_one_plan", _plan_sql(T0, T1))
def planner_one_plan(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_plan(spark, sf, T0, T1, planner.plan_in_one), "value")


@query("planner_on_read", f"""WITH {P} SELECT 'daily' AS tier, ts - ts % 86400 AS "at", round(sum(value) / count(*), 2) AS value, round(min(value), 2) AS min, round(max(value), 2) AS max, count(*) AS count
FROM p WHERE series = '{SERIES}' AND ts BETWEEN {T0} AND {T1} GROUP BY ts - ts % 86400""")
def planner_on_read(spark: SparkSession, sf: str) -> DataFrame:
    return planner.plan_on_read(event_points(spark, sf, SERIES, T0, T1), SERIES, T0, T1)


# -- chunks and codec --------------------------------------------------------------------------


@query("chunk_assignment", f"WITH RECURSIVE {CHUNKS} SELECT series, ts, value, seq, chunk FROM a")
def chunk_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return assign_chunks(event_points(spark, sf))


@query("chunk_index", f"""WITH RECURSIVE {CHUNKS} SELECT series, chunk, arg_min(ts, seq) AS start_time, arg_max(ts, seq) AS end_time, min(ts) AS min_ts, max(ts) AS max_ts,
count(*) AS point_count FROM a GROUP BY series, chunk""")
def chunk_index_query(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_index(assign_chunks(event_points(spark, sf)))


@query("chunk_pruning", f"""WITH RECURSIVE {CHUNKS} SELECT series, chunk, count(*) AS point_count FROM a GROUP BY series, chunk
HAVING max(ts) >= {T0 + DAY} AND min(ts) <= {T0 + 2 * DAY}""")
def chunk_pruning(spark: SparkSession, sf: str) -> DataFrame:
    index = chunk_index(assign_chunks(event_points(spark, sf)))
    return chunks_overlapping(index, T0 + DAY, T0 + 2 * DAY).select("series", "chunk", "point_count")


@query("time_deltas", f"""WITH {P}, d AS (SELECT *, ts - lag(ts) OVER (PARTITION BY series ORDER BY seq) AS delta FROM p)
SELECT series, seq, coalesce(delta, 0) AS delta, coalesce(delta - lag(delta) OVER (PARTITION BY series ORDER BY seq), 0) AS change FROM d""")
def time_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return codec.deltas(event_points(spark, sf), ["series"]).select("series", "seq", "delta", "change").fillna(0)


@query("time_bit_classes", f"""WITH {P}, d AS (SELECT *, ts - lag(ts) OVER (PARTITION BY series ORDER BY seq) AS delta FROM p),
c AS (SELECT *, delta - lag(delta) OVER (PARTITION BY series ORDER BY seq) AS change FROM d)
SELECT series, CASE WHEN change IS NULL THEN 64 WHEN change = 0 THEN 1 WHEN change BETWEEN -64 AND 63 THEN 9 WHEN change BETWEEN -256 AND 255 THEN 12
WHEN change BETWEEN -2048 AND 2047 THEN 16 WHEN change BETWEEN -2147483648 AND 2147483647 THEN 36 END AS bits, count(*) AS points FROM c GROUP BY ALL""")
def time_bit_classes(spark: SparkSession, sf: str) -> DataFrame:
    return codec.time_bits(event_points(spark, sf), ["series"]).groupBy("series", "bits").agg(F.count("*").alias("points"))


@query("codec_round_trip", f"WITH RECURSIVE {CHUNKS} SELECT series, chunk, ts, value FROM a")
def codec_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    files = codec.frame(codec.encode(assign_chunks(event_points(spark, sf))))
    return codec.decode(codec.unframe(files).where("error is null")).select("series", "chunk", "ts", "value")


@query("codec_sizes")
def codec_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return codec.sizes(codec.encode(assign_chunks(event_points(spark, sf))))


@query("value_windows", f"""WITH {P}, x AS (SELECT series, CAST(xor(CAST(value AS BIT), lag(CAST(value AS BIT)) OVER (PARTITION BY series ORDER BY seq)) AS VARCHAR) AS b FROM p)
SELECT series, CASE WHEN strpos(b, '1') = 0 THEN 64 ELSE strpos(b, '1') - 1 END AS lead, CASE WHEN strpos(b, '1') = 0 THEN 64 ELSE strpos(reverse(b), '1') - 1 END AS tail,
count(*) AS points FROM x WHERE b IS NOT NULL GROUP BY ALL""")
def value_windows(spark: SparkSession, sf: str) -> DataFrame:
    windows = codec.value_xor(event_points(spark, sf), ["series"]).where("xor is not null")
    return windows.groupBy("series", F.col("lead").cast("long").alias("lead"), F.col("tail").cast("long").alias("tail")).agg(F.count("*").alias("points"))


@query("codec_benchmark")
def codec_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return codec.sizes(codec.encode(assign_chunks(synthetic.benchmark_points(spark))))


# -- catalog -----------------------------------------------------------------------------------


@query("series_catalog", f"WITH {P} SELECT series AS name, count(*) AS point_count, CAST(0 AS BIGINT) AS disk_bytes, max(ts) AS last_updated FROM p GROUP BY series")
def series_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.series_catalog(event_points(spark, sf))


@query("server_stats", f"WITH {P} SELECT count(DISTINCT series) AS series_count, CAST(0 AS BIGINT) AS total_disk_bytes FROM p")
def server_stats(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.totals(catalog.series_catalog(event_points(spark, sf)))


@query("latest_points", f"WITH {P} SELECT series, arg_max(ts, seq) AS ts, arg_max(value, seq) AS value, max(seq) AS seq FROM p GROUP BY series")
def latest_points(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.latest_points(event_points(spark, sf))


@query("series_names", f"WITH {P} SELECT DISTINCT series FROM p")
def series_names(spark: SparkSession, sf: str) -> DataFrame:
    points = event_points(spark, sf)
    return catalog.series_names(points, points.where("value > 100"))


@query("name_options", f"WITH {P} SELECT series FROM p UNION SELECT unnest(['engine_temp', 'cpu_usage', 'mem_alloc'])")
def name_options(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.name_options(event_points(spark, sf))


@query("feed_status", "SELECT true AS weather, true AS crypto, true AS forex")
def feed_status(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.feed_status(synthetic.demo_points(spark.range(1)))


@query("tail_last_200", f"WITH {P} SELECT ts, value, seq FROM p WHERE series = '{SERIES}' ORDER BY seq DESC LIMIT {TAIL_LINES}")
def tail_last_200(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.tail(event_points(spark, sf, SERIES), SERIES, TAIL_LINES).select("ts", "value", "seq")


@query("chart_scaled", f"""WITH {P}, c AS (SELECT * FROM p WHERE series = '{SERIES}' AND ts BETWEEN {T0} AND {T0 + DAY})
SELECT ts, value, CAST((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS FLOAT) AS y,
       CAST(CAST(ts - min(ts) OVER () AS DOUBLE) / (max(ts) OVER () - min(ts) OVER ()) AS FLOAT) AS x FROM c""")
def chart_scaled(spark: SparkSession, sf: str) -> DataFrame:
    points = scan(event_points(spark, sf, SERIES, T0, T0 + DAY), SERIES, T0, T0 + DAY)
    return rounded(catalog.chart(points), "x", "y").select("ts", "value", "y", "x")


# -- alerts ------------------------------------------------------------------------------------


@query("alert_matches", f"WITH {P}, {_rules_sql()} SELECT series, ts, value, seq, rule_id, operator, threshold FROM m")
def alert_matches(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.matches(event_points(spark, sf), alerts.make_rules(spark, RULES))


@query("alert_cooldown_replay", f"WITH RECURSIVE {P}, {_rules_sql()}, {FIRED} SELECT rule_id, series, ts, value, seq FROM fired")
def alert_cooldown_replay(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.triggers(event_points(spark, sf), alerts.make_rules(spark, RULES), REPLAY_COOLDOWN).select("rule_id", "series", "ts", "value", "seq")


@query("newest_100_alerts", f"WITH RECURSIVE {P}, {_rules_sql()}, {FIRED} SELECT rule_id, series, ts, value, seq FROM fired ORDER BY seq DESC, rule_id DESC LIMIT 100")
def newest_100_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.newest(alert_cooldown_replay(spark, sf))


@query("alert_lines", f"""WITH {P}, {_rules_sql()} SELECT seq, rule_id, 'ALERT ' || rule_id || ',' || series || ',' || printf('%.6g', value) || ',' || operator || ',' || printf('%.6g', threshold) || ',' || ts AS line FROM m""")
def alert_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = alert_matches(spark, sf).withColumns({"v": format_g6("value"), "t": format_g6("threshold")})
    return found.select("seq", "rule_id", alerts.alert_line(F.col("v"), F.col("t")).alias("line"))


@query("alert_line_parse", f"WITH {P}, {_rules_sql()} SELECT rule_id, series, value, operator, threshold, ts AS timestamp FROM m")
def alert_line_parse(spark: SparkSession, sf: str) -> DataFrame:
    return protocol.parse_alert_lines(alert_lines(spark, sf), F.lit(0).cast("long"), "line")


# -- protocol, feeds, texts --------------------------------------------------------------------


@query("line_protocol_parse", f"WITH {P} SELECT series, ts, value, seq FROM p")
def line_protocol_parse(spark: SparkSession, sf: str) -> DataFrame:
    points = event_points(spark, sf)
    lines = points.select("seq", F.concat_ws("  ", F.lit(" write"), "series", F.col("ts").cast("string"), F.col("value").cast("string")).alias("value"))
    return protocol.write_points_of(protocol.parse_commands(lines))


BAD_LINES = [
    "WRITE", "WRITE s", "WRITE s x 42", "WRITE s 1735000000", "WRITE bad-series! 1 42", "WRITE s +5 1", "WRITE s 1 1.5d", "WRITE s 1 1e400", "FOOBAR a",
    "QUERY s 5 5", "QUERY s 5", "QUERY s! 1 2", "QUERY s a 2", "TAIL", "TAIL s-", "write ok 5 1e3", "query ok 1 2", "tail ok", "benchmark", "   ",
]
_ANSWERS = [
    protocol.WRITE_USAGE, protocol.WRITE_USAGE, protocol.WRITE_TIME, protocol.WRITE_USAGE, protocol.WRITE_SERIES, protocol.WRITE_TIME, protocol.WRITE_VALUE, protocol.WRITE_VALUE,
    "ERR unknown command: FOOBAR", protocol.QUERY_RANGE, protocol.QUERY_USAGE, protocol.QUERY_SERIES, protocol.QUERY_TIME, protocol.TAIL_USAGE, protocol.QUERY_SERIES, protocol.OK,
]


@query("line_protocol_errors", "SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{a}')" for i, a in enumerate(_ANSWERS)) + ") AS t(seq, answer)")
def line_protocol_errors(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.createDataFrame(list(enumerate(BAD_LINES)), "seq long, value string")
    return protocol.write_answers(protocol.parse_commands(lines)).select("seq", "answer")


@query("result_lines", f"WITH {P} SELECT ts AS \"at\", ts || ',' || printf('%.6g', value) AS line FROM p WHERE series = '{SERIES}' AND ts BETWEEN {T0} AND {T0 + 10799}")
def result_lines(spark: SparkSession, sf: str) -> DataFrame:
    return render.result_lines(_plan(spark, sf, T0, T0 + 10799))


@query("result_rows_parse", f"WITH {P} SELECT 'raw' AS kind, ts AS \"at\", value FROM p WHERE series = '{SERIES}' AND ts BETWEEN {T0} AND {T0 + 10799}")
def result_rows_parse(spark: SparkSession, sf: str) -> DataFrame:
    return protocol.parse_result_rows(result_lines(spark, sf), "line").select("kind", "at", "value")


@query("answer_kinds", "SELECT * FROM (VALUES ('alert', 1), ('ok', 1), ('error', 1), ('end', 1), ('benchmark', 1), ('row', 2), ('other', 1)) AS t(kind, n)")
def answer_kinds(spark: SparkSession, sf: str) -> DataFrame:
    lines = ["ALERT rule_1,s,95,>,90,5", "OK", "ERR x", "END", "1382400,580000,2.38", "5,1.5", "5,1,1,1,3", "hello", " "]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return protocol.classify_answers(df).groupBy("kind").agg(F.count("*").cast("int").alias("n"))


@query("result_json")
def result_json(spark: SparkSession, sf: str) -> DataFrame:
    return render.result_json(_plan(spark, sf, T0, T1), SERIES)


@query("result_json_raw", f"""WITH {P}, r AS (SELECT ts, value FROM p WHERE series = '{SERIES}' AND ts BETWEEN {T0} AND {T0 + 10799})
SELECT '{{"series":"{SERIES}","tier":"raw","points":[' || string_agg('{{"ts":' || ts || ',"value":' || value || '}}', ',' ORDER BY ts, value) || '],"count":' || count(*) || '}}' AS json FROM r HAVING count(*) > 0""")
def result_json_raw(spark: SparkSession, sf: str) -> DataFrame:
    return render.result_json(_plan(spark, sf, T0, T0 + 10799), SERIES)


@query("posted_json", "SELECT event_type AS series, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events")
def posted_json(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "ts", "props")
    k = F.get_json_object("props", "$.k").cast("double")
    body = F.to_json(F.struct(F.col("event_type").alias("series"), F.expr(EPOCH_SECONDS.format("ts")).alias("ts"), k.alias("value")))
    return feeds.posted_points(events.select(F.col("event_id").alias("seq"), body.alias("json"))).select("series", "seq", "ts", "value")


@query("feed_points", """SELECT series, CAST(value AS DOUBLE) AS value FROM (VALUES ('weather_temp_c', 31.5), ('weather_wind_kmh', 12.0), ('weather_humidity_pct', 40.0), ('btc_usd', 91000.5),
('forex_eur_USD', 1.08), ('forex_eur_GBP', 0.86)) AS t(series, value)""")
def feed_points(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda text: spark.createDataFrame([(0, text)], "ts long, json string")
    weather = feeds.weather_points(one('{"current": {"temperature_2m": 31.5, "wind_speed_10m": 12, "relative_humidity_2m": 40}}'))
    crypto = feeds.crypto_points(one('{"bitcoin": {"usd": 91000.5}, "dogecoin": {"usd": 1}}'))
    forex = feeds.forex_points(one('{"base": "EUR", "rates": {"USD": 1.08, "GBP": 0.86}}'))
    return union_all(weather, crypto, forex).select("series", "value")


def _demo_sql() -> str:
    rows = []
    for name, offset, terms in synthetic.DEMO_CURVES:
        curve = " + ".join([repr(offset), *[f"{a} * {f}(i * 0.05 * {s})" for a, f, s in terms]])
        rows.append(f"SELECT '{name}' AS series, CAST(2 * i AS BIGINT) AS ts, CAST({curve} AS FLOAT) AS value FROM t")
    return "WITH t AS (SELECT unnest(range(0, 500)) AS i) " + " UNION ALL ".join(rows)


@query("synthetic_demo", _demo_sql())
def synthetic_demo(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synthetic.demo_points(spark.range(500)), "value").select("series", "ts", "value")


@query("scalar_functions", """SELECT * FROM (VALUES ('uptime', '1h 2m 5s'), ('bytes', '1.5 KB'), ('megabytes', '2.00 MB'), ('ago', '3m ago'), ('chunk', 'chunk_0042.dat'),
('number', '42'), ('saved', '86'), ('hex', '0.25'), ('sign', 'none'), ('crc', '3421780262')) AS t(what, text)""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    made = {
        "uptime": scalar.uptime_text(F.lit(3725)),
        "bytes": scalar.bytes_text(F.lit(1536)),
        "megabytes": scalar.bytes_text(F.lit(2 << 20)),
        "ago": scalar.ago_text(F.lit(200)),
        "chunk": scalar.chunk_name(F.lit(42)),
        "number": scalar.chunk_number(F.lit("chunk_0042.dat")).cast("string"),
        "saved": scalar.saved_percent(F.lit(100.0), F.lit(14.0)).cast("string"),
        "hex": scalar.parse_f64(F.lit("0x1p-2")).cast("string"),
        "sign": F.coalesce(scalar.parse_u64(F.lit("+5")).cast("string"), F.lit("none")),
        "crc": F.crc32(F.lit(b"123456789")).cast("string"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("what"), v.alias("text")) for k, v in made.items()])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.what", "r.text")


# -- streams -----------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    return events.select(F.col("event_type").alias("series"), F.expr(EPOCH_SECONDS.format("ts")).alias("ts"), "value", F.col("event_id").alias("seq"))


@contextmanager
def _rocks(spark: SparkSession):
    """The state store that the stateful jobs need."""
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, rocks)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _stream(spark: SparkSession, sf: str, build) -> DataFrame:
    """Run a stream over the events until its input ends, and return what it wrote."""
    folder = shared_folder(spark, "stream")
    made = build(_event_stream(spark, sf))
    with _rocks(spark):
        sink = made.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/rows")


@query("stream_arrival_rollup", f"""WITH {RUNS}, {_days('closed')} SELECT series, 'hourly' AS tier, window_start, CAST(avg AS FLOAT) AS avg, min, max, count FROM f WHERE closed
UNION ALL SELECT series, 'daily', window_start, CAST(avg AS FLOAT), min, max, count FROM days""")
def stream_arrival_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_stream(spark, sf, jobs.arrival_rollup))


@query("stream_watermark_rollup", f"""WITH {P}, h AS (SELECT series, ts - ts % 3600 AS window_start, CAST(sum(value) / count(*) AS FLOAT) AS avg, min(value) AS min, max(value) AS max, count(*) AS count
FROM p GROUP BY ALL) SELECT * FROM h WHERE window_start + 3600 <= (SELECT max(ts) FROM p) - 3600""")
def stream_watermark_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_stream(spark, sf, jobs.watermark_rollup))


@query("stream_alerts", f"WITH RECURSIVE {P}, {_rules_sql()}, {FIRED} SELECT rule_id, series, ts, value, seq FROM fired")
def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    rules = alerts.make_rules(spark, RULES)
    return _stream(spark, sf, lambda points: jobs.alert_stream(points, rules, REPLAY_COOLDOWN)).select("rule_id", "series", "ts", "value", "seq")


@query("stream_tail", f"WITH {P} SELECT ts, value FROM p WHERE series = '{SERIES}'")
def stream_tail(spark: SparkSession, sf: str) -> DataFrame:
    return _stream(spark, sf, lambda points: jobs.tail(points, SERIES))
