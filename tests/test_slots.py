"""Slot windows: state per (machine, time slot), merged at the seams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterflow.operators import windows
from meterflow.streaming import feed, slots

START = dt.datetime(2024, 1, 1)


def _readings(spark, counts, minutes=30):
    rows = [(m, START + dt.timedelta(minutes=i * minutes), float((i * 7 + m * 3) % 50), m * 100_000 + i)
            for m, n in enumerate(counts) for i in range(n)]
    return spark.createDataFrame(rows, feed.READING_SCHEMA)


def _batch(df):
    return {(r.machine_id, r._ord): list(r.readings) for r in windows.trailing_windows(df).collect()}


def _collected(df):
    rows = df.collect()
    got = {(r.machine_id, r.end_ord): list(r.readings) for r in rows}
    assert len(got) == len(rows)
    return got


def _feed(spark, run, files_per_batch=None):
    return feed.read_feed(spark, f"{run}/src/*", files_per_batch)


@pytest.mark.parametrize("slot", ["6 hours", "2 days", "1000 days"])
def test_hot_machine_equals_batch_over_micro_batches_and_restart(spark, slot):
    # machine 0 has half of all readings; slots of 6 hours hold 12, fewer than a window
    df = _readings(spark, [300, 100, 100, 80, 23])
    run = feed.new_run_dir(spark, "test-slots")
    early = F.col("timestamp") < START + dt.timedelta(days=1, hours=7)
    df.filter(early).repartition(2, "machine_id").write.parquet(f"{run}/src/a")
    first = slots.run_windows(spark, _feed(spark, run), run, slot=slot).count()
    assert first == sum(max(0, min(n, 62) - 23) for n in (300, 100, 100, 80, 23))
    assert slots.run_windows(spark, _feed(spark, run), run, slot=slot).count() == first    # nothing new

    df.filter(~early).repartition(2, "machine_id").write.parquet(f"{run}/src/b")
    assert _collected(slots.run_windows(spark, _feed(spark, run), run, slot=slot)) == _batch(df)


def test_a_hot_machine_is_split_by_slot(spark):
    df = _readings(spark, [2000, 40])
    per_key = (df.groupBy("machine_id", F.floor(feed.to_micros("timestamp") / slots.microseconds("1 day")))
               .count().agg(F.max("count")).first()[0])
    assert per_key == 48                             # of 2,000 readings in one batch
    run = feed.new_run_dir(spark, "test-slots-hot")
    df.write.parquet(f"{run}/src/a")
    assert _collected(slots.run_windows(spark, _feed(spark, run), run, slot="1 day")) == _batch(df)


def test_late_reading_stands_in_its_own_slot(spark):
    df = _readings(spark, [96])
    run = feed.new_run_dir(spark, "test-slots-late")
    df.write.parquet(f"{run}/src/a")
    slots.run_windows(spark, _feed(spark, run), run, slot="1 day").count()
    late = spark.createDataFrame([(0, START + dt.timedelta(hours=10, minutes=5), 999.0, 7)], feed.READING_SCHEMA)
    late.write.parquet(f"{run}/src/b")
    got = slots.run_windows(spark, _feed(spark, run), run, slot="1 day").collect()
    assert len(got) == 96 + 1 - 23
    found = [r for r in got if 999.0 in r.readings]
    assert len(found) == 1                           # windows that were out before stay as they were
    day = [r.kwh for r in df.orderBy("timestamp").collect()][:48]
    assert list(found[0].readings) == day[-23:] + [999.0]


def test_timers_forget_old_slots(spark):
    df = _readings(spark, [480, 60])                 # ten days
    run = feed.new_run_dir(spark, "test-slots-timers")
    for i in range(5):                               # a file each two days
        start = START + dt.timedelta(days=2 * i)
        df.filter((F.col("timestamp") >= start) & (F.col("timestamp") < start + dt.timedelta(days=2))).coalesce(1).write.parquet(
            f"{run}/src/{i}")
    stream = slots.slot_windows(_feed(spark, run, files_per_batch=1), slot="1 day", keep="2 days")
    with slots.rocksdb(spark):
        q = feed.run_available(stream.writeStream.format("parquet").option("path", f"{run}/windows"), f"{run}/ckpt")
    assert spark.conf.get(slots.STORE_CONF) != slots.ROCKSDB
    wins = spark.read.schema(slots.SINK_SCHEMA).parquet(f"{run}/windows")
    assert _collected(slots.numbered(wins)) == _batch(df)
    states = [max(p["stateOperators"], key=lambda op: op["numRowsTotal"]) for p in q.recentProgress]
    assert sum(op["customMetrics"]["numDeletedTimers"] for op in states) == 7          # of 12 slots
    assert states[-1]["numRowsTotal"] == 2 * 5                                          # a list and a count each


def test_readings_without_machine_or_time_close_no_window(spark):
    df = _readings(spark, [30])
    odd = spark.createDataFrame([(None, START, 1.0, 1), (0, None, 1.0, 2)], feed.READING_SCHEMA)
    run = feed.new_run_dir(spark, "test-slots-odd")
    df.unionByName(odd).coalesce(1).write.parquet(f"{run}/src/a")
    assert _collected(slots.run_windows(spark, _feed(spark, run), run)) == _batch(df)
