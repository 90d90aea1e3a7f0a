"""Streaming: stream = batch, and a restart from the checkpoint adds only the
new rows (no duplicates, no gaps)."""

import datetime as dt

from pyspark.sql import functions as F

from meterflow.operators import windows
from meterflow.streaming import feed


def _readings(spark, machines=3, n=60, start=dt.datetime(2024, 1, 1)):
    rows = [(m, start + dt.timedelta(hours=i, minutes=m), float((i * 7 + m * 3) % 50), m * 1000 + i)
            for m in range(machines) for i in range(n)]
    return spark.createDataFrame(rows, feed.READING_SCHEMA)


def _batch_windows(df):
    out = windows.trailing_windows(df)
    return {(r.machine_id, r._ord): list(r.readings) for r in out.collect()}


def _stream_windows(spark, src, ckpt, out):
    stream = feed.window_stream(feed.read_feed(spark, src, files_per_batch=1))
    feed.run_available(stream.writeStream.format("parquet").option("path", out), ckpt)
    return spark.read.parquet(out)


def test_stream_equals_batch_and_restart(spark):
    df = _readings(spark)
    run = feed.new_run_dir(spark, "test-stream")
    src, ckpt, out = f"{run}/src", f"{run}/ckpt", f"{run}/out"
    early = df.filter(F.col("timestamp") < dt.datetime(2024, 1, 2, 6))
    late = df.subtract(early)

    early.repartition(3, "machine_id").write.parquet(f"{src}/a")
    first = _stream_windows(spark, f"{src}/*", ckpt, out)
    n_first = first.count()
    assert n_first == sum(max(0, c - 23) for c in
                          [r["count"] for r in early.groupBy("machine_id").count().collect()])

    # restart with no new files: nothing is added
    assert _stream_windows(spark, f"{src}/*", ckpt, out).count() == n_first

    # new files arrive: only their windows are added, state carried across
    late.repartition(3, "machine_id").write.parquet(f"{src}/b")
    got = _stream_windows(spark, f"{src}/*", ckpt, out).collect()
    got = {(r.machine_id, r.end_ord): list(r.readings) for r in got}
    assert len(got) == 3 * (60 - 23)
    assert got == _batch_windows(df)


def test_dedup_within_watermark(spark):
    schema = "machine_id bigint, end_ord long, timestamp timestamp_ntz, recon_error double"
    ev = spark.createDataFrame(
        [(1, 5, dt.datetime(2024, 1, 1, 10), 0.5), (2, 7, dt.datetime(2024, 1, 1, 11), 0.7)],
        schema)
    run = feed.new_run_dir(spark, "test-dedup")
    ev.write.parquet(f"{run}/src/a")
    s1 = feed.stream_of(spark, f"{run}/src", schema)
    s2 = feed.stream_of(spark, f"{run}/src", schema)
    out = feed.run_append(spark, feed.dedup_events(s1.unionByName(s2), keys=("machine_id", "end_ord")),
                          "test-dedup-out")
    assert sorted(r.end_ord for r in out.collect()) == [5, 7]


def test_idle_timeout_in_continuous_query(spark):
    import time
    df = _readings(spark, machines=2, n=30)
    run = feed.new_run_dir(spark, "test-idle")
    df.repartition(2, "machine_id").write.parquet(f"{run}/src/a")
    stream = feed.window_stream(feed.read_feed(spark, f"{run}/src/*"), idle_timeout_ms=3_600_000)
    q = (stream.writeStream.format("parquet").option("path", f"{run}/out")
         .option("checkpointLocation", f"{run}/ckpt").trigger(processingTime="1 second").start())
    try:
        deadline = time.time() + 120
        while time.time() < deadline and sum(p["numInputRows"] for p in q.recentProgress) < 60:
            time.sleep(1)
        time.sleep(2)
    finally:
        q.stop()
    assert spark.read.parquet(f"{run}/out").count() == 2 * (30 - 23)


def test_json_feed(spark):
    df = _readings(spark, machines=2, n=30)
    run = feed.new_run_dir(spark, "test-json")
    (df.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
     .repartition(2, "machine_id").write.json(f"{run}/src"))
    stream = feed.window_stream(feed.read_feed(spark, f"{run}/src", fmt="json"))
    out = feed.run_append(spark, stream, "test-json-out")
    assert out.count() == 2 * (30 - 23)


def test_a_busy_machines_windows_leave_in_bounded_frames():
    """A batch's windows of one machine, many times its readings, are never one frame."""
    import numpy as np
    import pandas as pd

    class State:
        hasTimedOut, exists = False, True
        get = ([float(i) for i in range(5)], 7)

        def update(self, new):
            self.get = new

    n, state = 3 * feed.WINDOW_CHUNK + 11, State()
    ids = np.random.default_rng(1).permutation(n)
    rows = pd.DataFrame({"machine_id": 4, "ts_us": ids, "kwh": ids + 5.0, "reading_id": ids})
    frames = list(feed._window_step(24)((4,), iter([rows[:100], rows[100:]]), state))
    assert max(map(len, frames)) <= feed.WINDOW_CHUNK
    got = pd.concat(frames, ignore_index=True)
    assert got["end_ord"].tolist() == list(range(7 + 18, 7 + n)) and got["end_us"].tolist() == list(range(18, n))
    assert all(w.tolist() == list(np.arange(e - 18.0, e + 6)) for w, e in zip(got["readings"], got["end_us"]))
    assert state.get == ([float(i) for i in range(n + 5 - 23, n + 5)], 7 + n)
