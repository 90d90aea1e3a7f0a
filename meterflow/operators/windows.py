"""Per-machine window operators.

All of them run on ``ordered_frames`` so a machine with a huge share of the
readings is split across tasks instead of landing in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from meterflow.constants import TRAIN_SPLIT, WINDOW
from meterflow.operators.ordered import CNT, ORD, ordered_frames


def _order(ts: str, tiebreak: str | None) -> list[str]:
    return [ts] + ([tiebreak] if tiebreak else [])


def window_features(df: DataFrame, key: str = "machine_id", ts: str = "timestamp",
                    value: str = "kwh", tiebreak: str | None = "reading_id",
                    lag_long: int = WINDOW, span: int = WINDOW,
                    keep_position: bool = False, chunk_rows: int | None = None) -> DataFrame:
    """W1 + W2: lag 1 and lag 24, and mean/std/max/min over the previous
    ``span`` rows (the current row excluded).  Frames count rows, not time."""

    def build(w: WindowSpec) -> dict:
        r = w.rowsBetween(-span, -1)
        return {
            "lag_1h": F.lag(value, 1).over(w),
            "lag_24h": F.lag(value, lag_long).over(w),
            "rolling_avg_24h": F.avg(value).over(r),
            "rolling_std_24h": F.stddev(value).over(r),
            "rolling_max_24h": F.max(value).over(r),
            "rolling_min_24h": F.min(value).over(r),
        }

    out = ordered_frames(df, key, _order(ts, tiebreak), build,
                         halo=max(span, lag_long), chunk_rows=chunk_rows)
    return out if keep_position else out.drop(ORD, CNT)


def sequence_windows(df: DataFrame, key: str = "machine_id", ts: str = "timestamp",
                     value: str = "kwh", tiebreak: str | None = "reading_id",
                     length: int = WINDOW, include_last: bool = False,
                     chunk_rows: int | None = None) -> DataFrame:
    """Overlapping sequences of ``length`` readings, stride 1.

    One row per window start: ``window_start`` (0-based position), the
    ``readings`` array and the start/end timestamps.  Like the reference, the
    last full window is left out unless ``include_last``; a machine with
    ``n`` rows gives ``max(0, n - length)`` windows.
    """

    def build(w: WindowSpec) -> dict:
        f = w.rowsBetween(0, length - 1)
        return {
            "readings": F.collect_list(value).over(f),
            "window_end_ts": F.last(ts).over(f),
        }

    out = ordered_frames(df, key, _order(ts, tiebreak), build, halo=length,
                         chunk_rows=chunk_rows)
    limit = F.col(CNT) - length + (1 if include_last else 0)
    return (
        out.filter(F.col(ORD) < limit)
        .select(F.col(key), F.col(ORD).alias("window_start"),
                F.col(ts).alias("window_start_ts"), "window_end_ts",
                "readings", F.col(CNT).alias("n_readings"))
    )


def trailing_windows(df: DataFrame, key: str = "machine_id", ts: str = "timestamp",
                     value: str = "kwh", tiebreak: str | None = "reading_id",
                     length: int = WINDOW, chunk_rows: int | None = None) -> DataFrame:
    """Window ending at each row (rows ``i-length+1 .. i``), for rows that
    have a full window; keeps ``_ord``/``_cnt``."""

    def build(w: WindowSpec) -> dict:
        return {"readings": F.collect_list(value).over(w.rowsBetween(-(length - 1), 0))}

    out = ordered_frames(df, key, _order(ts, tiebreak), build, halo=length,
                         chunk_rows=chunk_rows)
    return out.filter(F.col(ORD) >= length - 1)


def edge_windows(df: DataFrame, key: str = "machine_id", ts: str = "timestamp",
                 value: str = "kwh", tiebreak: str | None = "reading_id",
                 length: int = WINDOW, steps: int | None = None,
                 split: float = TRAIN_SPLIT, last_col: str | None = None,
                 chunk_rows: int | None = None) -> DataFrame:
    """The held-out scoring tail of each machine.

    With ``n`` readings, step ``s`` scores the ``length`` readings ending just
    before ``hour_index = floor(split*n) + length + s`` while
    ``hour_index < n``: the whole tail, or its first ``steps`` steps if given.  ``kwh_last`` reports ``last_col`` (default: the
    windowed value) of the window's last row.
    """
    out = trailing_windows(df, key, ts, value, tiebreak, length, chunk_rows)
    hour_index = F.col(ORD) + 1
    start = F.floor(F.col(CNT) * F.lit(split)) + length
    return (
        out.withColumn("hour_index", hour_index)
        .filter((hour_index >= start) & (hour_index < (
            F.col(CNT) if steps is None else F.least(F.col(CNT), start + steps))))
        .select(F.col(key), "hour_index", F.col(ts).alias("timestamp_last"),
                F.col(last_col or value).alias("kwh_last"), "readings")
    )


def last_n_per_key(df: DataFrame, n: int, key: str = "machine_id", ts: str = "timestamp",
                   tiebreak: str | None = "reading_id") -> DataFrame:
    """The last ``n`` rows of every key (in time order).  A rank limit, so
    each task keeps at most ``n`` rows a key before the shuffle."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in _order(ts, tiebreak)])
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def chrono_split(df: DataFrame, key: str = "machine_id", position: str = "window_start",
                 count: str | None = None, split: float = TRAIN_SPLIT) -> DataFrame:
    """Mark the first ``floor(split * count)`` rows of each key as train.

    ``position`` is a 0-based position; ``count`` the rows per key (taken from
    a grouped count when not given)."""
    if count is None:
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n_split"))
        df = df.join(counts, key)
        count = "_n_split"
    out = df.withColumn(
        "split", F.when(F.col(position) < F.floor(F.col(count) * F.lit(split)),
                        F.lit("train")).otherwise(F.lit("validation")))
    return out.drop("_n_split")
