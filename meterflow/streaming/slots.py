"""T1 for hot machines: 24-reading windows over (machine, time slot) state.

``feed.window_stream`` keeps one state per machine, so all readings that a
machine sends in a micro-batch go through one task.  Here the state key is
salted with the reading's time slot and the windows are merged at the seams:

1. *Slots.*  ``transformWithStateInPandas`` keyed by (machine, slot) keeps a
   list state of the slot's last ``length - 1`` readings and a count.  A reading
   with enough readings before it in its slot closes its window there; the
   first ``length - 1`` readings of a slot leave as *heads* with what they have,
   and each batch reports the slot's last readings as its *tail*.
2. *Seams.*  A second stateful operator keyed by (machine, lane) joins them.
   Heads and tails of a machine share one lane (at most ``2 * length`` rows a
   slot), where a head takes what it lacks from the tails of the slots before;
   finished windows pass through in the lane of their slot.

Readings of a machine are in the order of (slot, batch, time, reading_id): like
``window_stream`` while they arrive in time order, and a late reading stands in
its own slot rather than after the newest one.  Windows that are out already
are not changed by later arrivals.  A window's place in the machine follows from
(slot, pos) when the windows are read back (``numbered``).

With ``keep`` an event-time timer forgets a slot's state that long after its
end; readings that come later still are dropped by Spark's watermark.  Without
it nothing is dropped and a slot's last readings stay.
"""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from meterflow import constants as K
from meterflow.operators.ordered import ORD, with_ordinal
from meterflow.streaming import feed

#: The driver asks a Python worker of its own for the processors' state variables;
#: that one has no files of ``addPyFile``, so the processors travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Width of a slot.  A machine's readings of one slot and batch are one task's
#: group, so it should hold well over ``length`` readings of a busy machine and
#: no more than a task can sort.
SLOT = "1 day"
#: Slots behind a machine's newest whose tails stay for late heads.
LATE_SLOTS = 32
SEAM_LANE = -1
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SLOT_OUT = ("machine_id bigint, lane bigint, kind int, slot bigint, pos bigint, end_us bigint, "
            "readings array<double>")
WINDOW_OUT = "machine_id bigint, slot bigint, pos bigint, end_us bigint, readings array<double>"
WINDOW, HEAD, TAIL = 0, 1, 2


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


class SlotWindows(StatefulProcessor):
    """Windows inside one (machine, slot), and its head and tail."""

    def __init__(self, length: int, slot_us: int, keep_us: int | None = None):
        self.length, self.slot_us, self.keep_us = length, slot_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getListState("tail", "kwh double")
        self.seen = handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine, slot = key
        new = pd.concat(list(rows), ignore_index=True).sort_values(["ts_us", "reading_id"], kind="mergesort")
        first = self.seen.get()[0] if self.seen.exists() else 0
        values = [r[0] for r in self.tail.get()] if first else []
        held = len(values)
        values += new["kwh"].tolist()
        out = []
        for i, end in enumerate(new["ts_us"].tolist()):
            pos, at = first + i, held + i + 1
            kind, lane = (WINDOW, slot) if pos >= self.length - 1 else (HEAD, SEAM_LANE)
            out.append((machine, lane, kind, slot, pos, end, values[max(0, at - self.length):at]))
        tail = values[-(self.length - 1):]
        out.append((machine, SEAM_LANE, TAIL, slot, first + len(new), int(new["ts_us"].iloc[-1]), tail))
        self.tail.put([(v,) for v in tail])
        self.seen.update((first + len(new),))
        if self.keep_us is not None:                 # the same timer each time: set once
            end = (slot + 1) * self.slot_us + int(new["shift_us"].iloc[-1])
            self.handle.registerTimer((end + self.keep_us) // 1000)
        yield _frame(out, SLOT_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.tail.clear()
        self.seen.clear()
        yield _frame([], SLOT_OUT)

    def close(self) -> None:
        pass


class SeamWindows(StatefulProcessor):
    """Windows of a machine that reach over the edge of a slot."""

    def __init__(self, length: int, late_slots: int):
        self.length, self.late_slots = length, late_slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tails = handle.getListState("tails", "slot bigint, readings array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        if key[1] != SEAM_LANE:                      # finished in their slot
            yield new[[c.split()[0] for c in WINDOW_OUT.split(", ")]]
            return
        tails = {int(s): list(r) for s, r in self.tails.get()} if self.tails.exists() else {}
        for slot, readings in new.loc[new["kind"] == TAIL, ["slot", "readings"]].itertuples(index=False):
            tails[int(slot)] = list(readings)
        order, out = sorted(tails), []
        for slot, pos, end, readings in new.loc[new["kind"] == HEAD, ["slot", "pos", "end_us", "readings"]].itertuples(index=False):
            window = list(readings)
            for earlier in reversed([s for s in order if s < slot]):
                if len(window) == self.length:
                    break
                window = tails[earlier][len(window) - self.length:] + window
            if len(window) == self.length:
                out.append((key[0], slot, pos, end, window))
        # a slot holds a reading at least, so that many tails complete any head
        keep = order[-(self.length - 1 + self.late_slots):]
        self.tails.put([(s, tails[s]) for s in keep])
        yield _frame(out, WINDOW_OUT)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Stateful processors need the RocksDB state store: set while queries start
    and run, then put back."""
    before = spark.conf.get(STORE_CONF)
    spark.conf.set(STORE_CONF, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE_CONF, before)


def microseconds(interval: str) -> int:
    """Length of an interval like "12 hours"."""
    return int(pd.Timedelta(interval) / pd.Timedelta(microseconds=1))


def slot_windows(readings: DataFrame, length: int = K.WINDOW, slot: str = SLOT,
                 late_slots: int = LATE_SLOTS, keep: str | None = None) -> DataFrame:
    """T1 on a stream of readings: machine_id, slot, pos, window_end_ts and the
    last ``length`` readings, for each reading that closes a window.  Readings
    without machine or time close none.  Run it under ``rocksdb``."""
    slot_us, local = microseconds(slot), feed.to_micros("timestamp")
    shift = F.unix_micros(F.col("timestamp").cast("timestamp")) - local
    rows = readings.where("machine_id is not null and timestamp is not null")
    if keep is not None:
        rows = rows.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", keep)
    rows = rows.select("machine_id", F.floor(local / slot_us).cast("long").alias("slot"), local.alias("ts_us"),
                       "kwh", "reading_id", shift.alias("shift_us"), *(["event_time"] if keep is not None else []))
    parts = rows.groupBy("machine_id", "slot").transformWithStateInPandas(
        SlotWindows(length, slot_us, None if keep is None else microseconds(keep)),
        SLOT_OUT, "Append", "None" if keep is None else "EventTime")
    whole = parts.groupBy("machine_id", "lane").transformWithStateInPandas(
        SeamWindows(length, late_slots), WINDOW_OUT, "Append", "None")
    return whole.withColumn("window_end_ts", feed.from_micros("end_us")).drop("end_us")


def numbered(windows: DataFrame, length: int = K.WINDOW, chunk_rows: int | None = None) -> DataFrame:
    """Windows read back, with ``end_ord``, the place of their last reading in
    the machine: every reading from the ``length``-th on closes one window."""
    placed = with_ordinal(windows, "machine_id", ["slot", "pos"], chunk_rows)
    return placed.withColumn("end_ord", F.col(ORD) + (length - 1)).select(
        "machine_id", "end_ord", *[c for c in windows.columns if c not in ("machine_id", "slot", "pos")])


SINK_SCHEMA = "machine_id bigint, slot bigint, pos bigint, readings array<double>, window_end_ts timestamp_ntz"
LOG_SCHEMA = feed.LOG_SCHEMA.replace("end_ord long", "slot bigint, pos bigint")


def run_windows(spark: SparkSession, readings: DataFrame, run_dir: str, **options) -> DataFrame:
    """Run ``slot_windows`` over everything available and read the windows back."""
    with rocksdb(spark):
        feed.run_available(slot_windows(readings, **options).writeStream.format("parquet").option(
            "path", f"{run_dir}/windows"), f"{run_dir}/ckpt")
    return numbered(spark.read.schema(SINK_SCHEMA).parquet(f"{run_dir}/windows"),
                    options.get("length", K.WINDOW))


def run_scoring(spark: SparkSession, readings: DataFrame, bounds: DataFrame, limits: DataFrame, scorer,
                slices: int = 4, **options) -> dict:
    """``feed.run_scoring`` on slot windows: T1 -> T2 -> T3/T4."""
    from meterflow.operators import prep
    run = feed.new_run_dir(spark, "scoring-slots")
    src = feed.replay_folder(spark, readings, slices)
    live = prep.valid_readings(feed.read_feed(spark, src, feed.files_per_slice(spark)), strictly_positive=True)
    scored = feed.score_stream(slot_windows(live, **options), bounds, limits, scorer)
    paths = {"source": src, "log": f"{run}/log", "events": f"{run}/events"}
    with rocksdb(spark):
        feed.run_available(scored.writeStream.foreachBatch(
            feed.log_and_events_writer(paths["log"], paths["events"], place=("slot", "pos"))), f"{run}/ckpt")
    return paths
