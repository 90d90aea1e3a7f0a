"""Increments: daily moments, upserts of changed groups, late events, rejected records."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterflow.operators import insights, sequence, windows
from meterflow.sources import files, sinks
from meterflow.streaming import feed

START = dt.datetime(2024, 1, 1)


# --- X5: moments a day ------------------------------------------------------------------

def _windows(spark, days=12, per_day=6, machines=2):
    rng = np.random.default_rng(2)
    rows = [(m, START + dt.timedelta(days=d, hours=h), [float(x) for x in rng.random(24) * (m + 1)])
            for m in range(machines) for d in range(days - 3 * m) for h in range(per_day)]
    return spark.createDataFrame(rows, "machine_id bigint, timestamp timestamp_ntz, readings array<double>")


def _models(df):
    return {r.machine_id: (r.n_train, np.array(r["mean"]), np.array(r.projection)) for r in df.collect()}


def test_refit_from_daily_moments_equals_a_refit_on_the_windows(spark):
    wins = _windows(spark)
    path = f"{feed.new_run_dir(spark, 'test-moments')}/moments"
    # the table grows day by day: the last day comes later, as an append
    cut = dt.datetime(2024, 1, 9)
    for part in (wins.filter(F.col("timestamp") < cut), wins.filter(F.col("timestamp") >= cut)):
        sinks.write_table(insights.daily_moments(part), path, mode="append", partition_by=["day"])
    got = _models(insights.refit_recent(spark.read.parquet(path)))
    recent = insights.recent_days(wins)
    want = _models(sequence.fit_machine_pca(recent))
    assert {m: n for m, (n, _, _) in got.items()} == {0: 42, 1: 42} == {
        r.machine_id: r["count"] for r in recent.groupBy("machine_id").count().collect()}
    for m, (n, mean, projection) in want.items():
        assert got[m][0] == n and np.allclose(got[m][1], mean) and np.allclose(got[m][2], projection, atol=1e-9)


def test_moments_add_up_in_any_grouping(spark):
    wins = _windows(spark)
    whole = sequence.window_moments(wins, ["machine_id"])
    parts = sequence.window_moments(wins.withColumn("part", F.hour("timestamp")), ["machine_id", "part"])
    added = {r.machine_id: r for r in sequence.add_moments(parts, ["machine_id"]).collect()}
    for r in whole.collect():
        assert added[r.machine_id].n == r.n and np.allclose(added[r.machine_id].m, r.m)
    assert insights.refit_recent(insights.daily_moments(wins.limit(0))).count() == 0


def test_moments_are_never_larger_than_their_windows(spark):
    """Days of a few windows hold those, not the sums; null keys are a group; nothing is lost when a task holds one group."""
    wins = _windows(spark, per_day=2).unionByName(_windows(spark, days=1, per_day=30, machines=1).withColumn("machine_id", F.lit(None).cast("long")))
    daily = insights.daily_moments(wins).collect()
    assert sum(r.n for r in daily) == wins.count() and len(daily) == len({(r.machine_id, r.day) for r in daily})
    assert {len(r.m) for r in daily if r.machine_id is not None} == {2 * 24}
    # hour 24 to 29 of the null machine is the next day
    assert sorted((r.n, len(r.m)) for r in daily if r.machine_id is None) == [(6, 144), (24, 324)]
    rows = wins.select("machine_id", F.lit(1).cast("long").alias("n"), F.col("readings").alias("m"))
    single = rows.coalesce(1).mapInArrow(sequence._add_in_task(["machine_id"], 24, held=1), rows.schema).collect()
    whole = {r.machine_id: (r.n, r.m) for r in sequence.window_moments(wins, ["machine_id"]).collect()}
    for key, (n, m) in whole.items():
        assert sum(r.n for r in single if r.machine_id == key) == n
        x = np.array([r.readings for r in wins.collect() if r.machine_id == key])
        want = np.concatenate([x.mean(0), (x.T @ x / n)[np.triu_indices(24)]])
        assert np.allclose(m, want)


# --- T5/T6: update mode -------------------------------------------------------------------

def _log(spark, n, first=0):
    rows = [(START + dt.timedelta(hours=i), i % 5, i, float(i), float(i), 0.1 * i, 1.0, int(i % 4 == 0), int(i % 6 == 0), None)
            for i in range(first, first + n)]
    return spark.createDataFrame(rows, feed.LOG_SCHEMA)


LATEST = "machine_id bigint, kwh double, is_anomaly int, recon_error double, last_updated timestamp_ntz"


def test_updates_over_two_batches_and_a_replay(spark):
    run = feed.new_run_dir(spark, "test-upsert")
    src, table = f"{run}/src", f"{run}/table"

    def go():
        agg = feed.latest_stream(feed.read_feed(spark, f"{src}/*", 1, feed.LOG_SCHEMA))
        feed.run_available(agg.writeStream.outputMode("update").foreachBatch(feed.upsert_writer(table)), f"{run}/ckpt")
        return feed.read_upserts(spark, table, LATEST, ["machine_id"])

    def rows(df):
        return sorted(map(tuple, df.collect()))

    _log(spark, 20).coalesce(1).write.parquet(f"{src}/a")
    assert rows(go()) == rows(feed.latest_stream(_log(spark, 20)))
    _log(spark, 3, first=20).coalesce(1).write.parquet(f"{src}/b")
    second = rows(go())
    assert second == rows(feed.latest_stream(_log(spark, 23)))
    changed = spark.read.parquet(f"{table}/b00000001")
    assert changed.count() == 3                      # only the groups of the second batch

    replayed = spark.createDataFrame(changed.drop("_batch").collect(), LATEST)
    feed.upsert_writer(table)(replayed, 1)           # a replayed batch changes nothing
    assert rows(feed.read_upserts(spark, table, LATEST, ["machine_id"])) == second
    compact = feed.compact_upserts(spark, table, f"{run}/compact", LATEST, ["machine_id"])
    assert rows(feed.read_upserts(spark, compact, LATEST, ["machine_id"])) == second
    assert feed.read_upserts(spark, f"{run}/none", LATEST, ["machine_id"]).count() == 0


def test_global_counters_in_update_mode(spark):
    run = feed.new_run_dir(spark, "test-upsert-global")
    for i, part in enumerate((_log(spark, 10), _log(spark, 7, first=10))):
        part.coalesce(1).write.parquet(f"{run}/src/{i}")
    log = feed.read_feed(spark, f"{run}/src/*", 1, feed.LOG_SCHEMA)
    got = feed.run_updates(spark, feed.metrics_stream(log), "test-upsert-metrics", [])
    assert got.collect() == feed.metrics_stream(_log(spark, 17)).collect()


# --- T10: late events -----------------------------------------------------------------------

EVENT = "machine_id bigint, end_ord long, timestamp timestamp_ntz, recon_error double"


def test_late_events_stay_and_state_is_bounded(spark):
    """30 events in three batches, each of them doubled; the last file is two days late."""
    events = [(i % 4, i, START + dt.timedelta(days=3, hours=i) if i < 20 else START + dt.timedelta(hours=i), 0.5) for i in range(30)]
    run = feed.new_run_dir(spark, "test-late")
    for k in range(3):
        part = events[10 * k:10 * k + 10]
        copies = part + part[:5] if k < 2 else part + part + events[:2]     # two events of the first batch again
        spark.createDataFrame(copies, EVENT).coalesce(1).write.parquet(f"{run}/src/{k}")

    def stream():
        return feed.read_feed(spark, f"{run}/src/*", 1, EVENT)

    got = feed.run_dedup(spark, stream, "test-late-dedup", "1 hour", keys=("machine_id", "end_ord"))
    assert sorted(r.end_ord for r in got.collect()) == list(range(30))

    q = feed.run_available(feed.dedup_events(stream(), delay="1 hour", keys=("machine_id", "end_ord"))
                           .writeStream.format("noop"), f"{run}/ckpt-state")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert held[-1] <= 2                             # not the thirty events


# --- S3, S11: rejected records -----------------------------------------------------------------

def test_csv_lines_are_read_or_rejected(spark):
    run = feed.new_run_dir(spark, "test-rejects")
    lines = ["machine_id,timestamp,kwh,site_id", "1,2024-01-01 00:00:00,5.5,1", "1,2024-01-01 01:00:00,n/a,1",
             "1,yesterday,5.5,1", "1,2024-01-01 02:00:00,,1", "1,2024-01-01 03:00:00,-2,1", "x,2024-01-01 03:00:00,1,1",
             "2,2024-01-01 04:00:00,7,", "2,,7,1", "3,2024-01-01 05:00:00,7", "3,2024-01-01 06:00:00,7,1,9"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{run}/csv")
    good, rejects = files.ingest_with_rejects(spark, f"{run}/csv")
    assert sorted((r.machine_id, r.kwh) for r in good.collect()) == [(1, 5.5), (2, 7.0), (2, 7.0)]
    found = sorted((r.reason, r.record) for r in rejects.collect())
    assert [reason for reason, _ in found] == ["kwh", "kwh"] + ["malformed"] * 4 + ["timestamp"]
    assert ("malformed", "3,2024-01-01 05:00:00,7") in found and ("malformed", "3,2024-01-01 06:00:00,7,1,9") in found
    assert any('"kwh":"n/a"' in record for _, record in found) and any('"machine_id":"x"' in record for _, record in found)
    assert good.count() + rejects.count() == len(lines) - 1
    # asking for one column still finds the malformed lines of the others
    assert good.select("site_id").count() == 3
    plain = files.ingest_processed(spark, f"{run}/csv")
    assert plain.where("kwh is null").count() == 0


def test_json_feed_is_read_or_rejected(spark):
    run = feed.new_run_dir(spark, "test-json-rejects")
    lines = ['{"machine_id":1,"timestamp":"2024-01-01T00:00:00","kwh":1.5,"reading_id":1}', '{"machine_id":1,"times',
             '{"machine_id":"one","timestamp":"2024-01-01T00:00:00","kwh":1.5,"reading_id":2}', 'no json',
             '{"machine_id":2,"kwh":2.5}']
    for i, part in enumerate((lines[:3], lines[3:])):
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.text(f"{run}/src/{i}")
    accepted, rejected = feed.run_quarantine(spark, f"{run}/src/*", "test-json-quarantine", files_per_batch=1)
    assert sorted((r.machine_id, r.kwh, r.reading_id) for r in accepted.collect()) == [(1, 1.5, 1), (2, 2.5, None)]
    assert sorted(r.record for r in rejected.collect()) == sorted(lines[1:4])


# --- J4, X4 ------------------------------------------------------------------------------------

def test_parameters_attach_by_a_join(spark):
    df = spark.range(3)
    params = spark.createDataFrame([(0.5, "x")], "threshold double, name string")
    from meterflow.operators import prep
    out = prep.attach_params(df, params)
    assert [(r.threshold, r.name) for r in out.collect()] == [(0.5, "x")] * 3
    assert prep.attach_params(df, params.limit(0)).where("threshold is null").count() == 3


def test_adaptive_threshold_counts_what_follows_the_warm_up(spark):
    rows = [(1, START + dt.timedelta(hours=i // 2), float(i % 5) if i < 24 else 100.0 * (i % 2), i) for i in range(40)]
    rows += [(2, START, 1.0, 100)]
    df = spark.createDataFrame(rows, feed.READING_SCHEMA).repartition(4)
    got = {r.machine_id: r for r in insights.adaptive_threshold(df).collect()}
    first = np.array([float(i % 5) for i in range(24)])
    assert got[1].threshold == pytest.approx(first.mean() + 3 * first.std())
    assert (got[1].n_after, got[1].n_above, got[2].n_after) == (16, 8, 0)
    assert windows.trailing_windows(df).count() == 17
