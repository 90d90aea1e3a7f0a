"""Structured Streaming form of the live scoring path.

``readStream`` over a folder of reading files -> per-machine 24-reading
state (``applyInPandasWithState``) -> stateless scoring through stream-static
joins -> one ``foreachBatch`` that writes the prediction log and the anomaly
events (idempotent per batch id) -> counters and latest state as streaming
aggregates.  Every query keeps its progress in a checkpoint folder under
``spark.checkpoint.dir``, so a restart resumes without duplicating rows.

State per machine is bounded (the last 23 readings and a counter).  Rows of
one machine are sorted by time inside a micro-batch; rows that arrive in a
later batch with an earlier time stay in arrival order.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from meterflow import constants as K
from meterflow.functions import columns as C
from meterflow.operators.prep import sized_broadcast
from meterflow.sources.files import path_exists
from meterflow.session import scratch_path

READING_SCHEMA = "machine_id bigint, timestamp timestamp_ntz, kwh double, reading_id bigint"
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def to_micros(col: str) -> F.Column:
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{col}`)")


def from_micros(col: str) -> F.Column:
    return F.expr(f"timestampadd(MICROSECOND, `{col}`, {_EPOCH})")


# --- source (S11) -----------------------------------------------------------------------------

def replay_folder(spark: SparkSession, readings: DataFrame, slices: int = 4,
                  name: str = "replay", key: str = "machine_id") -> str:
    """Write ``readings`` as ``slices`` time-ordered file groups (one write per
    slice, oldest first).  Each slice is hash-partitioned by machine, so one
    machine's rows of a slice sit in one file: however the file stream cuts
    micro-batches, every machine's rows arrive in time order."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    bounds = readings.agg(F.min(to_micros("timestamp")).alias("lo"),
                          F.max(to_micros("timestamp")).alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    if lo is None:
        readings.limit(0).write.parquet(f"{path}/slice=0")
        return path
    width = (hi - lo) / slices + 1
    tagged = readings.withColumn("_slice", F.floor((to_micros("timestamp") - F.lit(lo)) / width))
    for i in range(slices):
        part = tagged.filter(F.col("_slice") == i).drop("_slice")
        part.repartition(key).write.mode("append").parquet(path)
    return path


def files_per_slice(spark: SparkSession) -> int:
    """Upper bound on the files one replay slice is written as (its shuffle
    partitions).  Any batch size keeps each machine's rows in time order --
    files are taken oldest first and a machine has one file per slice -- so
    this only sets how many micro-batches a replay takes (about one per slice)."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


CORRUPT = "_corrupt_record"


def read_feed(spark: SparkSession, path: str, files_per_batch: int | None = None,
              schema: str = READING_SCHEMA, fmt: str = "parquet", keep_corrupt: bool = False) -> DataFrame:
    """A stream of readings files (parquet or JSON) with a fixed schema.
    ``keep_corrupt`` adds the text of lines that do not fit it (JSON, CSV)."""
    if keep_corrupt:
        schema = f"{schema}, {CORRUPT} string"
    reader = spark.readStream.schema(schema).format(fmt)
    if keep_corrupt:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def quarantine_writer(accepted: str, rejected: str):
    """Each batch's lines in two tables, a folder a batch: readings that fit the
    schema, and the text of the lines that do not.  None is lost."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            (batch.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
             .write.mode("overwrite").parquet(f"{accepted}/b{batch_id:08d}"))
            (batch.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("record"))
             .write.mode("overwrite").parquet(f"{rejected}/b{batch_id:08d}"))
        finally:
            batch.unpersist()
    return write


def run_quarantine(spark: SparkSession, path: str, name: str, schema: str = READING_SCHEMA, fmt: str = "json",
                   files_per_batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Read a feed to its end; (accepted readings, rejected records)."""
    run = new_run_dir(spark, name)
    lines = read_feed(spark, path, files_per_batch, schema, fmt, keep_corrupt=True)
    run_available(lines.writeStream.foreachBatch(quarantine_writer(f"{run}/accepted", f"{run}/rejected")), f"{run}/ckpt")
    return (read_table(spark, f"{run}/accepted", schema), read_table(spark, f"{run}/rejected", "record string"))


# --- T1: per-machine sliding window state -----------------------------------------------------

WINDOW_OUT = "machine_id bigint, end_ord long, end_us long, readings array<double>"
WINDOW_STATE = "vals array<double>, seen long"


def _empty_windows() -> pd.DataFrame:
    return pd.DataFrame({"machine_id": pd.Series([], dtype="int64"),
                         "end_ord": pd.Series([], dtype="int64"),
                         "end_us": pd.Series([], dtype="int64"),
                         "readings": pd.Series([], dtype="object")})


#: Windows of one frame that a task hands to Spark: a machine's batch of readings
#: is held once, its windows (``length`` times as much) only so many at a time.
WINDOW_CHUNK = 4096


def _window_step(length: int, idle_timeout_ms: int | None = None, chunk: int = WINDOW_CHUNK):
    keep = length - 1

    def step(key, batches, state):
        if state.hasTimedOut:                # machine idle too long: forget it
            state.remove()
            yield _empty_windows()
            return
        new = pd.concat([b[["ts_us", "reading_id", "kwh"]] for b in batches], ignore_index=True)
        new = new.sort_values(["ts_us", "reading_id"], kind="mergesort")
        if state.exists:
            prev_vals, seen = state.get
            prev = np.asarray(prev_vals if prev_vals is not None else [], dtype=np.float64)
        else:
            prev, seen = np.empty(0), 0
        n_new, end_us = len(new), new["ts_us"].to_numpy()
        vals = np.concatenate([prev, new["kwh"].to_numpy(dtype=np.float64)])
        del new
        state.update((vals[-keep:].tolist(), int(seen + n_new)))
        if idle_timeout_ms:
            state.setTimeoutDuration(idle_timeout_ms)
        first = max(0, keep - len(prev))                 # the first new row that closes a window
        if first >= n_new:
            yield _empty_windows()
            return
        wins = np.lib.stride_tricks.sliding_window_view(vals, length)   # a view: one row a closing row
        offset = len(prev) - keep                        # window of new row i: wins[i + offset]
        for a in range(first, n_new, chunk):
            b = min(a + chunk, n_new)
            yield pd.DataFrame({
                "machine_id": key[0],
                "end_ord": np.arange(seen + a, seen + b),    # their position in the machine
                "end_us": end_us[a:b],
                "readings": list(wins[a + offset:b + offset].copy()),
            })

    return step


def window_stream(feed: DataFrame, length: int = K.WINDOW,
                  idle_timeout_ms: int | None = None) -> DataFrame:
    """Each arriving reading closes the window of the machine's last
    ``length`` readings (emitted once the machine has ``length`` readings).

    ``idle_timeout_ms`` drops a machine's state after that long without
    readings, so state does not grow with every machine ever seen (a machine
    that returns starts a new window sequence).  It is meant for a
    continuously running query (processing-time trigger): while timeouts are
    pending Spark keeps scheduling no-data batches, so an ``availableNow``
    replay with a timeout would not finish."""
    rows = feed.select("machine_id", to_micros("timestamp").alias("ts_us"), "kwh", "reading_id")
    timeout = (GroupStateTimeout.ProcessingTimeTimeout if idle_timeout_ms
               else GroupStateTimeout.NoTimeout)
    out = rows.groupBy("machine_id").applyInPandasWithState(
        _window_step(length, idle_timeout_ms), WINDOW_OUT, WINDOW_STATE, "append", timeout)
    return out.withColumn("window_end_ts", from_micros("end_us")).drop("end_us")


# --- T2: scoring -------------------------------------------------------------------------------

def score_stream(wins: DataFrame, bounds: DataFrame, limits: DataFrame, scorer) -> DataFrame:
    """Scale with the machine's bounds, score, flag and decide alerts,
    using the emulator's forecast (last reading x 1.05).  ``bounds`` and
    ``limits`` are static tables joined to the stream.  ``scorer`` is a scorer of
    ``sequence`` or a function (windows, arr) -> windows with ``recon_error``,
    such as ``Bundle.score`` with a model a machine (M9)."""
    from meterflow.operators import events, sequence
    # A window that fails validation is not scored (the service answers
    # such a request with a rejection and logs nothing)
    s = wins.withColumn("predicted_kwh", C.last_element("readings") * K.FORECAST_UPLIFT)
    s = events.validate_requests(s).filter("is_valid").drop("rejection", "is_valid")
    s = s.join(sized_broadcast(bounds), "machine_id", "left")
    s = sequence.scale_window_array(s)
    s = scorer(s, "scaled_readings") if callable(scorer) else sequence.score(s, scorer, arr="scaled_readings")
    s = s.join(sized_broadcast(limits.select("machine_id", "threshold")), "machine_id", "left")
    return events.decide_alerts(s).withColumnRenamed("window_end_ts", "request_ts")


# --- T3/T4: sinks ---------------------------------------------------------------------------------

def log_and_events_writer(log_path: str, events_path: str, place: tuple = ("end_ord",)):
    """T3 + T4 in one ``foreachBatch``: every scored row to the log, flagged
    rows to the anomaly events.  Each batch writes its own folder with
    overwrite, so a replayed batch replaces instead of duplicating.  ``place``
    names the columns with a window's place in its machine."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            log = batch.select(
                F.col("request_ts").alias("timestamp"), "machine_id", *place,
                F.round(C.last_element("readings"), 3).alias("actual_kwh"),
                F.round("predicted_kwh", 3).alias("predicted_kwh"),
                F.round("recon_error", 6).alias("recon_error"),
                F.round("threshold", 6).alias("threshold"),
                F.col("is_anomaly").cast("int").alias("is_anomaly"),
                F.col("alert_fired").cast("int").alias("alert_sent"),
                F.lit(None).cast("double").alias("latency_ms"))
            log.write.mode("overwrite").parquet(f"{log_path}/b{batch_id:08d}")
            log.filter(F.col("is_anomaly") == 1).write.mode("overwrite").parquet(
                f"{events_path}/b{batch_id:08d}")
        finally:
            batch.unpersist()

    return write


def run_available(query_builder, checkpoint: str):
    """Start a query over everything available, wait for it, stop it."""
    q = query_builder.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    exc = q.exception()
    if exc is not None:
        raise RuntimeError(str(exc))
    return q


# --- T5/T6/X1: streaming aggregates ------------------------------------------------------------

def metrics_stream(log: DataFrame) -> DataFrame:
    """T5: running counters (A9) over the scored stream."""
    from meterflow.operators import rollups
    return rollups.scoring_metrics(log)


def latest_stream(log: DataFrame) -> DataFrame:
    """Latest reading, flag and error per machine (``max_by``)."""
    order = F.struct("timestamp", "end_ord")
    return log.groupBy("machine_id").agg(
        F.max_by(F.struct("actual_kwh", "is_anomaly", "recon_error", "timestamp"), order)
        .alias("s")).select(
        "machine_id", F.col("s.actual_kwh").alias("kwh"), F.col("s.is_anomaly").alias("is_anomaly"),
        F.col("s.recon_error").alias("recon_error"), F.col("s.timestamp").alias("last_updated"))


def kpi_stream(feed: DataFrame) -> DataFrame:
    """Machine KPIs (count, mean, max, min) kept up to date on a stream.

    The mean is taken over DECIMAL values: the running sum is then exact, so
    the result does not depend on how rows fall into micro-batches."""
    exact = F.col("kwh").cast("decimal(28,8)")
    return feed.groupBy("machine_id").agg(
        F.count("kwh").alias("total_readings"),
        F.round(F.avg(exact), 2).cast("double").alias("avg_kwh"),
        F.round(F.max("kwh"), 2).alias("peak_kwh"), F.round(F.min("kwh"), 2).alias("min_kwh"))


def overwrite_writer(path: str):
    """Sink for complete-mode aggregates: each batch replaces the table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)
    return write


UPSERT_BATCH = "_batch"


def upsert_writer(path: str):
    """Sink for update-mode aggregates: the groups that a batch changed go to
    the batch's own folder, overwritten when the batch is replayed.  The state
    of the table is each group's row of its newest batch (``read_upserts``)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn(UPSERT_BATCH, F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{path}/b{batch_id:08d}")
    return write


def read_upserts(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The current row of each group (of the only group without ``keys``): a
    partial aggregate over the changes, not a window."""
    changes = read_table(spark, path, f"{schema}, {UPSERT_BATCH} long")
    columns = [c for c in changes.columns if c not in (*keys, UPSERT_BATCH)]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*columns), UPSERT_BATCH).alias("_r"))
    return newest.where("_r is not null").select(*keys, "_r.*")


def compact_upserts(spark: SparkSession, path: str, out: str, schema: str, keys: list[str]) -> str:
    """The current rows as one first batch of a new table at ``out``: later
    batches may be copied behind it, so that reads stay short."""
    upsert_writer(out)(read_upserts(spark, path, schema, keys), 0)
    return out


def run_updates(spark: SparkSession, agg: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an aggregate in update mode to completion and read its table."""
    run = new_run_dir(spark, name)
    run_available(agg.writeStream.outputMode("update").foreachBatch(upsert_writer(f"{run}/table")), f"{run}/ckpt")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in agg.schema)
    return read_upserts(spark, f"{run}/table", schema, keys)


# --- T9/T10 -----------------------------------------------------------------------------------------

def enrich_stream(feed: DataFrame, metadata: DataFrame, key: str = "building_id") -> DataFrame:
    """Stream-static left join with machine metadata."""
    return feed.join(sized_broadcast(metadata), key, "left")


def dedup_events(events: DataFrame, ts: str = "timestamp", delay: str | None = None,
                 keys: tuple = ("machine_id", "recon_error")) -> DataFrame:
    """Drop the second copy of an event that two relays both emitted.
    Without ``delay`` every distinct event stays, however late, and the state
    grows with the distinct events; with it the state is bounded, but events
    later than ``delay`` are dropped.
    Watermarks need ``TIMESTAMP``; the NTZ time is cast (session time zone)
    only for the watermark column, the event keeps its own time."""
    ev = events.withColumn("_event_time", F.col(ts).cast("timestamp"))
    if delay is None:
        return ev.dropDuplicates(["_event_time", *keys]).drop("_event_time")
    return (ev.withWatermark("_event_time", delay)
            .dropDuplicatesWithinWatermark(["_event_time", *keys]).drop("_event_time"))


def late_writer(maxima: str, late: str, delay: str, ts: str = "timestamp"):
    """The rows that a watermark of ``delay`` may call late, batch by batch:
    those at or below the greatest time of this batch and all before, less
    ``delay``.  A batch's greatest time is one row in its own folder, so a
    replayed batch finds the same limit and overwrites the same output."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        (batch.agg(F.max(ts).alias("top")).withColumn("id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").parquet(f"{maxima}/b{batch_id:08d}"))
        limit = (spark.read.schema("top timestamp_ntz, id long").parquet(f"{maxima}/*").where(F.col("id") <= batch_id)
                 .agg((F.max("top") - F.expr(f"INTERVAL {delay}")).alias("_limit")))
        (batch.crossJoin(F.broadcast(limit)).where(F.col(ts) <= F.col("_limit")).drop("_limit")
         .write.mode("overwrite").parquet(f"{late}/b{batch_id:08d}"))
    return write


def run_dedup(spark: SparkSession, events, name: str, delay: str, keys: tuple = ("machine_id", "recon_error"),
              ts: str = "timestamp") -> DataFrame:
    """T10 with bounded state and no event lost: doubled events that arrive
    within ``delay`` go through the watermark's state; what the watermark drops
    as late is routed to a late table, deduplicated and added unless the event
    is out already (an anti-join with the late rows, few as they are).

    ``events`` is a function that returns the stream, read by two queries."""
    run = new_run_dir(spark, name)
    schema = events().schema
    run_available(dedup_events(events(), ts, delay, keys).writeStream.format("parquet").option("path", f"{run}/first"),
                  f"{run}/ckpt-first")
    run_available(events().writeStream.foreachBatch(late_writer(f"{run}/maxima", f"{run}/late", delay, ts)),
                  f"{run}/ckpt-late")
    first = spark.read.schema(schema).parquet(f"{run}/first")
    late = read_table(spark, f"{run}/late", schema).dropDuplicates([ts, *keys])
    same = [late[c].eqNullSafe(first[c]) for c in (ts, *keys)]
    return first.unionByName(late.join(first, same, "left_anti"))


# --- runners ------------------------------------------------------------------------------------------

LOG_SCHEMA = ("timestamp timestamp_ntz, machine_id bigint, end_ord long, actual_kwh double, "
              "predicted_kwh double, recon_error double, threshold double, is_anomaly int, "
              "alert_sent int, latency_ms double")


def new_run_dir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def run_scoring(spark: SparkSession, readings: DataFrame, bounds: DataFrame, limits: DataFrame,
                scorer, slices: int = 4, files_per_batch: int | None = None) -> dict:
    """Replay ``readings`` as a feed and run T1 -> T2 -> T3/T4 to completion.
    Returns the folders of the source, the log and the anomaly events."""
    from meterflow.operators import prep
    run = new_run_dir(spark, "scoring")
    src = replay_folder(spark, readings, slices)
    # the feed keeps only readings with a positive value, as the emulator does
    feed = prep.valid_readings(read_feed(spark, src, files_per_batch or files_per_slice(spark)),
                               strictly_positive=True)
    scored = score_stream(window_stream(feed), bounds, limits, scorer)
    paths = {"source": src, "log": f"{run}/log", "events": f"{run}/events"}
    run_available(scored.writeStream.foreachBatch(
        log_and_events_writer(paths["log"], paths["events"])), f"{run}/ckpt")
    return paths


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Batch read of a sink folder (per-batch subfolders); empty if absent."""
    if not path_exists(spark, path):                # no batch written yet
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/*")


def stream_of(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a sink folder written batch by batch (the next hop)."""
    return read_feed(spark, f"{path}/*", files_per_batch, schema)


def run_complete(spark: SparkSession, agg: DataFrame, name: str) -> DataFrame:
    """Run a complete-mode aggregate to completion and read its table."""
    run = new_run_dir(spark, name)
    out = f"{run}/table"
    run_available(agg.writeStream.outputMode("complete").foreachBatch(overwrite_writer(out)),
                  f"{run}/ckpt")
    return spark.read.parquet(out)


def run_append(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream into a parquet sink and read it back."""
    run = new_run_dir(spark, name)
    out = f"{run}/table"
    run_available(stream.writeStream.format("parquet").option("path", out), f"{run}/ckpt")
    return spark.read.schema(stream.schema).parquet(out)
