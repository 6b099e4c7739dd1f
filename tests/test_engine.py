"""Reference behaviour of the time-series engine: rollups, planner, alerts, protocol, catalog."""

import math
import random

import pytest

from meridian import model
from meridian.api import Engine
from meridian.functions import scalar
from meridian.operators import alerts, catalog, render, rollup
from meridian.operators.folds import assign_chunks, chunk_index, chunks_overlapping, cooldown
from meridian.plans import planner
from meridian.sources import feeds, lines, points, synthetic

F = scalar.F
HOUR, DAY = model.HOUR, model.DAY


def table(spark, rows):
    """Points from (series, ts, value) in order of arrival."""
    return spark.createDataFrame([(s, t, float(v), i) for i, (s, t, v) in enumerate(rows)], model.POINTS)


def records(df):
    return sorted((r.series, r.window_start, round(r.avg, 9), r.min, r.max, r["count"]) for r in df.collect())


def test_hour_closes_when_the_next_begins(spark):
    p = table(spark, [("s", 3_600_000 + i, 50 + i) for i in range(10)] + [("s", 3_603_600 + i, 100 + i) for i in range(5)])
    assert records(rollup.hourly(p)) == [("s", 3_600_000, 54.5, 50.0, 59.0, 10)]
    assert len(records(rollup.hourly(p, include_open=True))) == 2


def test_day_is_the_weighted_mean_of_24_hours(spark):
    rows = [("s", 8_640_000 + HOUR * h + i, h + 0.1 * i) for h in range(24) for i in range(10)]
    p = table(spark, rows + [("s", 8_726_400, 999.0)])
    assert records(rollup.daily(rollup.hourly(p))) == [("s", 8_640_000, 11.95, 0.0, pytest.approx(23.9), 240)]
    open_last = table(spark, rows)
    assert records(rollup.daily(rollup.hourly(open_last))) == []
    assert len(records(rollup.daily(rollup.hourly(open_last, include_open=True)))) == 1
    holes = table(spark, [r for r in rows if r[1] // HOUR % 24 != 5] + [("s", 8_726_400, 1.0)])
    assert records(rollup.daily(rollup.hourly(holes))) == []


def test_coming_back_to_an_hour_makes_another_record(spark):
    p = table(spark, [("s", h * HOUR, h) for h in (1, 2, 1, 2)])
    assert len(records(rollup.hourly(p))) == 3 and len(records(rollup.hourly(p, include_open=True))) == 4
    assert len(records(rollup.rollup(p))) == 2


def test_runs_join_across_stretches(spark, monkeypatch):
    rows = [("s", (i // 7) * 500, i) for i in range(200)]
    whole = records(rollup.arrival_runs(table(spark, rows)))
    monkeypatch.setattr(rollup, "STRETCH", 3)
    assert records(rollup.arrival_runs(table(spark, rows))) == whole


def test_nan_never_wins_an_extreme(spark):
    nan = float("nan")
    got = {r.series: r for r in rollup.rollup(table(spark, [("a", 0, nan), ("a", 1, 2), ("a", 2, 1), ("b", 0, nan)])).collect()}
    assert (got["a"]["min"], got["a"]["max"], got["a"]["count"]) == (1.0, 2.0, 3) and math.isnan(got["a"].avg)
    assert (got["b"]["min"], got["b"]["max"]) == (math.inf, -math.inf)


@pytest.fixture(scope="module")
def tiers(spark):
    rows = [("s", d * DAY + h * HOUR + m * 600, h + m / 10) for d in range(20, 24) for h in range(24) for m in range(6)] + [("s", 24 * DAY, 1.0)]
    p = table(spark, rows).cache()
    hours = rollup.hourly(p).cache()
    return p, hours, rollup.daily(hours).cache()


@pytest.mark.parametrize("plan", [planner.plan, planner.plan_in_one])
@pytest.mark.parametrize("width, tier", [(10_799, "raw"), (10_800, "hourly"), (172_799, "hourly"), (172_800, "daily")])
def test_width_picks_the_tier(tiers, plan, width, tier):
    start = 20 * DAY
    assert {r.tier for r in plan(*tiers, "s", start, start + width).collect()} == {tier}


def test_planner_falls_back_and_wraps(spark, tiers):
    p, hours, days = tiers
    none = days.limit(0)
    assert {r.tier for r in planner.plan(p, hours, none, "s", 20 * DAY, 24 * DAY).collect()} == {"hourly"}
    assert {r.tier for r in planner.plan(p, none, none, "s", 20 * DAY, 24 * DAY).collect()} == {"raw"}
    assert planner.plan(*tiers, "unknown", 0, 9_999_999_999).collect() == []
    everything = planner.plan(*tiers, "s", 0, (1 << 64) - 1)
    assert {r.tier for r in everything.collect()} == {"raw"} and everything.count() == p.count()


def test_day_overlap_uses_an_hour_unless_strict(tiers):
    start, end = 21 * DAY + HOUR, 25 * DAY
    ats = lambda **k: sorted(r.at // DAY for r in planner.plan(*tiers, "s", start, end, **k).collect())
    assert ats() == [22, 23] and ats(strict_overlap=True) == [21, 22, 23]
    assert sorted(r.at // DAY for r in planner.plan(*tiers, "s", start - 1, end).collect()) == [21, 22, 23]


def test_full_coverage_refuses_a_tier_with_gaps(tiers):
    some = planner.plan(*tiers, "s", 20 * DAY, 40 * DAY)
    full = planner.plan(*tiers, "s", 20 * DAY, 40 * DAY, coverage="full")
    assert {r.tier for r in some.collect()} == {"daily"} and {r.tier for r in full.collect()} == {"raw"}


def test_on_read_includes_open_windows(spark):
    p = table(spark, [("s", 0, 1.005), ("s", 5, 2.0)])
    (r,) = planner.plan_on_read(p, "s", 0, 20_000).collect()
    assert (r.tier, r.at, r["count"]) == ("hourly", 0, 2)


def test_range_is_closed_and_keeps_duplicates(spark):
    p = table(spark, [("s", 1, 1), ("s", 2, 2), ("s", 2, 2), ("s", 3, 3), ("t", 2, 9)])
    assert sorted(r.ts for r in points.scan(p, "s", 2, 3).collect()) == [2, 2, 3]


def test_point_table_prunes_days(spark, tmp_path):
    p = table(spark, [("s", d * DAY + 5, d) for d in range(10)])
    points.write_points(p, str(tmp_path / "t"))
    hit = points.scan(points.read_points(spark, str(tmp_path / "t")), "s", 3 * DAY, 4 * DAY - 1)
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(series)" in plan
    assert [r.value for r in hit.collect()] == [3.0]


def test_event_scan_pushes_its_filters(spark):
    plan = points.event_points(spark, "/root/testdata/sf0.001", "click", 1704067200, 1704153600)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "EqualTo(event_type,click)" in plan and "props" not in plan.split("ReadSchema")[1]


def test_chunks_close_by_count_and_by_span(spark):
    by_span = chunk_index(assign_chunks(table(spark, [("s", 60 * i, i) for i in range(300)]))).orderBy("chunk").collect()
    assert [r.point_count for r in by_span] == [121, 121, 58]
    by_count = chunk_index(assign_chunks(table(spark, [("s", 5, i) for i in range(25)]), max_points=10)).orderBy("chunk").collect()
    assert [r.point_count for r in by_count] == [10, 10, 5]
    late = chunk_index(assign_chunks(table(spark, [("s", 100, 1), ("s", 50, 2), ("s", 70, 3)])))
    assert chunks_overlapping(late, 40, 60).count() == 1


def test_alert_rules(spark):
    rules = alerts.make_rules(spark, [("s", o, 5.0) for o in model.OPERATORS] + [("s", "==", math.nan)])
    p = table(spark, [("s", 0, 4), ("s", 1, 5), ("s", 2, 6), ("s", 3, math.nan), ("t", 4, 9)])
    got = {(r.operator, r.value) for r in alerts.matches(p, rules).collect()}
    assert got == {(">", 6.0), ("<", 4.0), (">=", 5.0), (">=", 6.0), ("<=", 4.0), ("<=", 5.0), ("==", 5.0)}
    assert alerts.seed_defaults(rules.limit(0)).count() == 3 and alerts.seed_defaults(rules).count() == 6
    assert alerts.delete_rule(rules, "rule_0").count() == 5
    with pytest.raises(ValueError, match="invalid operator"):
        alerts.make_rules(spark, [("s", "!=", 1.0)])
    with pytest.raises(ValueError, match="cannot be empty"):
        alerts.make_rules(spark, [("", ">", 1.0)])


def test_rules_survive_json(spark, tmp_path):
    rules = alerts.make_rules(spark, [("s", ">", 5.0), ("t", "<=", -1.5)])
    alerts.rules_json(rules).select(F.col("json").alias("value")).coalesce(1).write.text(str(tmp_path / "rules"))
    assert sorted(map(tuple, alerts.load_rules(spark, str(tmp_path / "rules")).collect())) == sorted(map(tuple, rules.collect()))


def slow_cooldown(ts, seconds):
    out, last = [], None
    for t in ts:
        if last is None or t - last >= seconds:
            out.append(t)
            last = t
    return out


def test_cooldown_is_greedy_and_takes_disorder(spark):
    import random

    r = random.Random(1)
    ts = [0, 1, 4, 5, 6, 10, 9, 3, 14, 100, 101, 50, 104, 105, 106] + [200 + r.randrange(300) for _ in range(200)]
    df = spark.createDataFrame([("r", t, i) for i, t in enumerate(ts)] + [("q", t, i) for i, t in enumerate(ts)], "rule_id string, ts long, seq long")
    got = sorted(cooldown(df, 5).collect(), key=lambda x: (x.rule_id, x.seq))
    assert [x.ts for x in got if x.rule_id == "r"] == [x.ts for x in got if x.rule_id == "q"] == slow_cooldown(ts, 5)


def test_demo_curves_fire_every_third_tick(spark):
    p = synthetic.demo_points(spark.range(30))
    first = {r.series: r.value for r in p.where("ts = 0").collect()}
    assert first == {"weather_temp_c": 28.0, "weather_wind_kmh": 21.0, "weather_humidity_pct": 55.0, "btc_usd": 88400.0, "eth_usd": 3200.0,
                     "forex_eur_USD": 1.085, "forex_eur_GBP": pytest.approx(0.8575), "forex_eur_JPY": 162.5}
    fired = alerts.triggers(p, alerts.make_rules(spark, [("btc_usd", ">", 80000.0)]))
    assert [r.ts // 2 for r in fired.orderBy("seq").collect()] == list(range(0, 30, 3))


def test_newest_hundred(spark):
    df = spark.createDataFrame([("r", i, i) for i in range(101)], "rule_id string, ts long, seq long")
    assert [r.seq for r in alerts.newest(df).collect()] == list(range(100, 0, -1))


@pytest.mark.parametrize("text, want", [("0", 0), ("007", 7), ("9223372036854775807", 2**63 - 1), ("9223372036854775808", None), ("+5", None), ("-5", None),
                                        ("1.0", None), ("", None), ("5\n", None), (" 5", None), ("9" * 60, None), (None, None)])
def test_parse_u64(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(scalar.parse_u64(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("text, want", [("1", 1.0), ("-1.5e3", -1500.0), (".5", 0.5), ("5.", 5.0), ("1.5d", None), ("1e400", None), ("0x1p-2", 0.25), ("-0x1.8p1", -3.0),
                                        ("inf", math.inf), ("-Infinity", -math.inf), ("", None), (" 2", None), ("x", None), ("2\n", None), (None, None)])
def test_parse_f64(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(scalar.parse_f64(F.col("t"))).first()[0] == want


def test_parse_nan(spark):
    assert math.isnan(spark.createDataFrame([("NaN",)], "t string").select(scalar.parse_f64(F.col("t"))).first()[0])


def test_six_significant_digits(spark):
    want = [(42.5, "42.5"), (88000.0, "88000"), (1735000000.0, "1.735e+09"), (1e-5, "1e-05"), (1234567.0, "1.23457e+06"), (math.inf, "+Inf"), (-math.inf, "-Inf"), (math.nan, "NaN")]
    df = spark.createDataFrame([(v, w) for v, w in want], "v double, w string")
    assert all(r.g == r.w for r in df.select("w", scalar.format_g6("v").alias("g")).collect())


def test_bit_views(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, -0.0, 1.0, 0.3, math.inf)], "v double").select("v", scalar.float_bits("v").alias("b"))
    got = df.select("v", scalar.bits_float("b").alias("w"), scalar.leading_zeros(F.col("b")).alias("l"), scalar.trailing_zeros(F.col("b")).alias("t")).collect()
    assert all(math.copysign(1, r.v) == math.copysign(1, r.w) and r.v == r.w for r in got)
    assert [(r.l, r.t) for r in got[:3]] == [(64, 64), (0, 63), (2, 52)]


@pytest.mark.parametrize("name, ok", [("cpu_1", True), ("abc\n", False), ("", False), ("a b", False), ("é", False), (None, False)])
def test_series_names(spark, name, ok):
    assert spark.createDataFrame([(name,)], "s string").select(model.valid_series(F.col("s"))).first()[0] is ok


def test_engine_session(spark):
    e = Engine(table(spark, [("old", 5, 1.0)]))
    script = ["write test_metric 1735000000 42.5", *[f"WRITE qtest {2_000_000_000 + i} {1.5 * i}" for i in range(10)], "FOOBAR arg1", "QUERY qtest 2000000000 2000000009",
              "QUERY nothing 1 2", "QUERY qtest 5 5", ""]
    out = e.run(spark.createDataFrame(list(enumerate(script)), "seq long, value string")).collect()
    by = {}
    for r in out:
        by.setdefault(r.seq, []).append(r.line)
    assert by[0] == ["OK"] and by[11] == ["ERR unknown command: FOOBAR"] and by[14] == ["ERR start must be less than end"] and 15 not in by
    assert sorted(by[12])[:2] == ["2000000000,0", "2000000001,1.5"] and len(by[12]) == 11 and "END" in by[12]
    assert by[13] == ["END"]
    assert e.query_lines("old", 1, 9).collect()[-1].line == "END"
    with pytest.raises(ValueError):
        e.query("old", 5, 5)
    raw, packed, ratio = e.benchmark().first().line.split(",")
    assert raw == "1382400" and float(ratio) >= 1.5 and int(packed) < 1382400
    assert [tuple(r) for r in e.series().collect()] == [("old", 1, 0, 5)]
    assert tuple(e.stats().first()) == (1, 0)
    assert e.alerts().count() == 0


def test_json_and_exports(spark, tmp_path, tiers):
    import json

    e = Engine(*tiers)
    answer = json.loads(e.query_json("s", 20 * DAY, 24 * DAY - 1).first().json)
    assert answer["tier"] == "daily" and answer["count"] == len(answer["points"]) == 4 and set(answer["points"][0]) == {"window_start", "avg", "min", "max", "count"}
    e.export("s", 20 * DAY, 24 * DAY, str(tmp_path / "days"))
    assert spark.read.csv(str(tmp_path / "days"), header=True).columns == render.ROLLUP_HEADER.split(",")
    e.export("s", 20 * DAY, 20 * DAY + 600, str(tmp_path / "raw"), "other")
    assert spark.read.csv(str(tmp_path / "raw"), header=True).columns == render.RAW_HEADER.split(",")
    e.export("s", 20 * DAY, 20 * DAY + 600, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert render.export_name("x", "s", 1, 2, "csv") == "x_s_1_2.csv"
    assert render.collapsed(e.query("s", 20 * DAY, 24 * DAY - 1)).columns == ["timestamp", "value"]
    assert [r.line for r in render.point_lines(table(spark, [("s", 7, 1.25)])).collect()] == ["7,1.25"]
    assert [r.line for r in render.rollup_lines(rollup.rollup(table(spark, [("s", 7, 1.25)]))).collect()] == ["0,1.25,1.25,1.25,1"]


def test_posted_points_and_feeds(spark):
    now = F.lit(777).cast("long")
    rows = ['{"series":"a","ts":5,"value":1.5}', '{"series":"a","value":2}', '{"series":"a","ts":0,"value":3}', '{"series":"bad name","ts":1,"value":1}', "not json"]
    got = feeds.posted_points(spark.createDataFrame(list(enumerate(rows)), "seq long, json string"), now).collect()
    assert sorted((r.ts, r.value) for r in got) == [(5, 1.5), (777, 2.0), (777, 3.0)]
    one = lambda t: spark.createDataFrame([(1, t)], "ts long, json string")
    assert [r.series for r in feeds.crypto_points(one('{"ethereum": {"usd": 3}, "bitcoin": {"eur": 1}}')).collect()] == ["eth_usd"]
    assert feeds.weather_points(one("{}")).count() == 0
    assert [(r.series, r.value) for r in feeds.forex_points(one('{"rates": {"USD": 1.1}}')).collect()] == [("forex_eur_USD", 1.1)]


def test_catalog(spark, tmp_path):
    p = table(spark, [("b", 1, 1), ("a", 9, 2), ("a", 3, 5)])
    sizes = spark.createDataFrame([("a", 100)], "series string, bytes long")
    assert [tuple(r) for r in catalog.series_catalog(p, sizes).collect()] == [("a", 2, 100, 9), ("b", 1, 0, 1)]
    assert [(r.series, r.ts) for r in catalog.latest_points(p).orderBy("series").collect()] == [("a", 3), ("b", 1)]
    points.write_points(p, str(tmp_path / "t"))
    assert catalog.stored_bytes(spark, str(tmp_path / "t")).agg(F.sum("bytes")).first()[0] > 0
    flat = catalog.chart(table(spark, [("s", 1, 5), ("s", 2, 5)])).collect()
    assert [r.y for r in flat] == [0.0, 0.0]


def test_missing_points_are_inserted_once(spark):
    grid = synthetic.minute_grid(spark, "s", 0, 600)
    stored = table(spark, [("s", 60, 1.0)])
    assert points.insert_missing(stored, grid).count() == 11
    assert all(45 <= r.value <= 55 for r in grid.collect())


def test_alert_lines_parse(spark):
    df = spark.createDataFrame([("ALERT rule_1,s,95.5,>,90,7",), ("ALERT rule_1,s,95.5,>,90",), ("ALERT a,b",)], "value string")
    assert [(r.rule_id, r.value, r.timestamp) for r in lines.parse_alert_lines(df, F.lit(3).cast("long")).collect()] == [("rule_1", 95.5, 7), ("rule_1", 95.5, 3)]
    assert alerts.trigger_for_test(spark, "", 5).first().series == "test_metric"


def test_session_answers_in_order(spark):
    script = ["QUERY s 1 9", "WRITE s 5 1.5", "QUERY s 1 9", "TAIL s", "WRITE s 6 2", "WRITE t 7 1", "QUERY s 1 9"]
    by = {}
    for r in Engine(table(spark, [])).run(spark.createDataFrame(list(enumerate(script)), "seq long, value string")).collect():
        by.setdefault(r.seq, []).append(r.line)
    assert by[0] == ["END"] and sorted(by[2]) == ["5,1.5", "END"] and by[3] == ["6,2"] and sorted(by[6]) == ["5,1.5", "6,2", "END"]


def test_write_keeps_stored_tiers(spark, tmp_path):
    p = table(spark, [("s", 5, 1.0)])
    hours = rollup.rollup(table(spark, [("s", 3600 * i, 7.0) for i in range(20)]))
    e = Engine(p, hours, rollup.merge_up(hours).limit(0)).write(table(spark, [("s", 9, 2.0)]))
    assert {r.tier for r in e.query("s", 0, 20_000).collect()} == {"hourly"} and e.query("s", 0, 100).count() == 2
    points.write_points(p, str(tmp_path / "t"))
    grown = Engine(points.read_points(spark, str(tmp_path / "t"))).write(table(spark, [("s", 9, 2.0)]))
    assert sorted(r.value for r in grown.query("s", 0, 100).collect()) == [1.0, 2.0]


def test_rules_by_the_facade(spark):
    e = Engine(table(spark, [("s", 5, 95.0)])).add_rule("s", ">", 90.0).add_rule("s", "<", 1.0)
    ids = [r.id for r in e.list_rules().collect()]
    assert len(ids) == len(set(ids)) == len(alerts.DEFAULT_RULES) + 2
    (fired,) = e.alerts().collect()
    assert e.delete_rule(fired.rule_id).alerts().count() == 0
    with pytest.raises(ValueError):
        e.add_rule("s", "!=", 1.0)


def test_a_repeated_batch_is_stored_once(spark, tmp_path):
    rows = [("s", 86_400 * (i % 3) + i, float(i)) for i in range(30)]
    for batch, some in ((0, rows[:20]), (1, rows[20:]), (0, rows[:20])):
        points.write_points(table(spark, some), str(tmp_path / "t"), batch=batch)
    assert sorted(r.value for r in points.read_points(spark, str(tmp_path / "t")).collect()) == [float(i) for i in range(30)]


def test_lags_and_bursts_across_stretches(spark, monkeypatch):
    from meridian.operators import codec, folds

    rng = random.Random(1)
    rows = [(s, rng.randrange(1000), float(rng.randrange(9))) for s in "ab" for _ in range(150)]
    p = table(spark, rows)
    whole = lambda: (
        sorted((r.series, r.seq, r.delta, r.change) for r in codec.deltas(p, ["series"]).collect() if r.change is not None),
        sorted((r.series, r.seq) for r in folds.cooldown(p.withColumnRenamed("series", "rule_id").withColumn("series", F.lit("x")), 40).select(F.col("rule_id").alias("series"), "seq").collect()),
    )
    want = whole()
    monkeypatch.setattr(rollup, "STRETCH", 7)
    monkeypatch.setattr(folds, "STRETCH", 7)
    assert whole() == want


def test_json_points_of_one_second_go_by_value(spark, tmp_path):
    import json

    import duckdb

    from meridian.plans import registry

    values = [114.25, 9.5, 56.25, -3.0, -20.0, 12345678.5, 0.0001, 1e-7, 2e16, 107.0, 9.5]
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01 00:00:0{i % 2}.5', 'click', {v!r}::DOUBLE)" for i, v in enumerate(values))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) AS t(event_id, ts, event_type, value)) TO '{tmp_path}/events.parquet'")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = registry.result_json_raw(spark, str(tmp_path)).first().json
    assert got == db.sql(registry.SQL["result_json_raw"]).fetchall()[0][0]
    bad = render.result_json(planner.plan_on_read(table(spark, [("s", 1, math.nan), ("s", 2, 1.5)]), "s", 0, 9), "s").first().json
    assert json.loads(bad)["points"] == [{"ts": 1, "value": None}, {"ts": 2, "value": 1.5}]
