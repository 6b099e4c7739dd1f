"""Streams give what the batch operators give."""

import pytest

from meridian.model import POINTS
from meridian.operators import alerts, rollup
from meridian.sources.points import read_points
from meridian.streaming import jobs


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Three files of points in order of arrival, and all of them as a table."""
    folder = str(tmp_path_factory.mktemp("feed"))
    rows = [(f"s{i % 2}", 20 * 86400 + 600 * i, float(i % 37), i) for i in range(600)]
    for k in range(3):
        spark.createDataFrame(rows[200 * k : 200 * (k + 1)], POINTS).coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.createDataFrame(rows, POINTS)


def finish(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_arrival_rollup_equals_batch(spark, feed):
    folder, points = feed
    got = finish(jobs.arrival_rollup(jobs.point_stream(spark, folder)), "arrival").collect()
    hours = rollup.hourly(points)
    key = lambda r: (r.series, r.window_start, round(r.avg, 9), r["count"])
    assert sorted(key(r) for r in got if r.tier == "hourly") == sorted(key(r) for r in hours.collect())
    assert sorted(key(r) for r in got if r.tier == "daily") == sorted(key(r) for r in rollup.daily(hours).collect()) != []


def test_watermark_rollup_gives_closed_windows(spark, feed):
    folder, points = feed
    got = {(r.series, r.window_start): r["count"] for r in finish(jobs.watermark_rollup(jobs.point_stream(spark, folder, 1)), "marked").collect()}
    want = {(r.series, r.window_start): r["count"] for r in rollup.rollup(points).collect()}
    assert got.items() <= want.items() and len(got) >= len(want) - 8


def test_alert_stream_equals_batch(spark, feed):
    folder, points = feed
    rules = alerts.make_rules(spark, [("s0", ">", 30.0), ("s1", "<=", 3.0)])
    got = finish(jobs.alert_stream(jobs.point_stream(spark, folder), rules, 5000), "alerts").collect()
    assert sorted((r.rule_id, r.seq) for r in got) == sorted((r.rule_id, r.seq) for r in alerts.triggers(points, rules, 5000).collect())


def test_ingest_stores_and_fans_out(spark, feed, tmp_path):
    folder, points = feed
    seen = []
    q = jobs.ingest(jobs.point_stream(spark, folder, 1), str(tmp_path / "t"), str(tmp_path / "c"), lambda batch, i: seen.append(batch.count()))
    q.awaitTermination()
    assert sum(seen) == 600 and read_points(spark, str(tmp_path / "t")).drop("day").exceptAll(points).isEmpty()
    assert finish(jobs.tail(jobs.point_stream(spark, folder), "s1"), "tailed").count() == 300


def test_stored_tiers_grow_once(spark, feed, tmp_path):
    """Records are stored as windows close; a batch that is run again stores nothing twice."""
    folder, points = feed
    t, c = str(tmp_path / "t"), str(tmp_path / "c")
    jobs.store_tiers(jobs.point_stream(spark, folder, 1), t, c).awaitTermination()
    last = max((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as after a crash between the sink and the commit
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    jobs.store_tiers(jobs.point_stream(spark, folder, 1), t, c).awaitTermination()
    hours, days = jobs.read_tiers(spark, t)
    key = lambda r: (r.series, r.window_start, round(r.avg, 9), r["count"])
    want = rollup.hourly(points)
    assert sorted(key(r) for r in hours.collect()) == sorted(key(r) for r in want.collect())
    assert sorted(key(r) for r in days.collect()) == sorted(key(r) for r in rollup.daily(want).collect())


def test_many_subscribers(spark, feed):
    folder, points = feed
    who = spark.createDataFrame([("a", "s0"), ("b", "s1"), ("c", "s1"), ("d", "none")], "subscriber string, series string")
    got = finish(jobs.tail_many(jobs.point_stream(spark, folder), who), "followed").groupBy("subscriber").count().collect()
    assert {r[0]: r[1] for r in got} == {"a": 300, "b": 300, "c": 300}
