"""Features the reference describes in prose only (X1-X5), built as plain
DataFrame jobs; none of them emits pairs of machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterflow import constants as K
from meterflow.operators import sequence
from meterflow.operators.prep import sized_broadcast


def adaptive_threshold(readings: DataFrame, key: str = "machine_id", ts: str = "timestamp",
                       value: str = "kwh", tiebreak: str | None = "reading_id",
                       warmup: int = K.WINDOW, sigmas: float = K.THRESHOLD_SIGMAS) -> DataFrame:
    """Per-machine threshold ``mean + 3 * population std`` of its first
    ``warmup`` readings, and how many later readings exceed it."""
    order = [ts] + ([tiebreak] if tiebreak else [])
    # a rank limit: each task keeps at most ``warmup`` rows a key before the shuffle
    oldest = Window.partitionBy(key).orderBy(*order)
    first = readings.withColumn("_rank", F.row_number().over(oldest)).filter(F.col("_rank") <= warmup)
    base = first.groupBy(key).agg(
        F.avg(value).alias("baseline_mean"), F.stddev_pop(value).alias("baseline_std"),
        F.max(F.struct(*order)).alias("_last"))
    base = base.withColumn("threshold", F.col("baseline_mean") + sigmas * F.col("baseline_std"))
    later = readings.join(base.select(key, "threshold", "_last"), key).filter(F.struct(*order) > F.col("_last"))
    above = later.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_after"),
        F.sum((F.col(value) > F.col("threshold")).cast("long")).alias("n_above"))
    return base.drop("_last").join(above, key, "left").fillna(0, subset=["n_after", "n_above"])


def recent_window(readings: DataFrame, key: str = "machine_id", ts: str = "timestamp",
                  days: int = 7) -> DataFrame:
    """Each machine's readings from the last ``days`` days of its own
    history (retraining set).  The per-machine latest time is a partial
    aggregate joined back, not a window over the whole machine."""
    last = readings.groupBy(key).agg(F.max(ts).alias("_last"))
    out = readings.join(last, key)
    return out.filter(F.col(ts) > F.col("_last") - F.make_dt_interval(F.lit(days))).drop("_last")


def daily_moments(windows: DataFrame, key: str = "machine_id", ts: str = "timestamp", arr: str = "readings") -> DataFrame:
    """One row of moments per machine and day of the windows' end.  Written
    partitioned by ``day`` it grows by the new day's rows alone."""
    return sequence.window_moments(windows.withColumn("day", F.to_date(ts)), [key, "day"], arr)


def refit_recent(moments: DataFrame, key: str = "machine_id", days: int = 7, k: int = K.LATENT_DIM) -> DataFrame:
    """Each machine's bottleneck from the moments of its last ``days`` days,
    added up: the same model as a fit on those days' windows."""
    last = moments.groupBy(key).agg(F.max("day").alias("_last"))
    recent = moments.join(last, key).filter(F.col("day") > F.date_sub("_last", days))
    return sequence.fit_from_moments(sequence.add_moments(recent, [key]), key, k)


def recent_days(windows: DataFrame, key: str = "machine_id", ts: str = "timestamp", days: int = 7) -> DataFrame:
    """The windows that ``refit_recent`` covers."""
    last = windows.groupBy(key).agg(F.to_date(F.max(ts)).alias("_last"))
    return windows.join(last, key).filter(F.to_date(ts) > F.date_sub("_last", days)).drop("_last")


def hourly_load(readings: DataFrame, key: str = "machine_id", ts: str = "timestamp",
                value: str = "kwh") -> DataFrame:
    return readings.groupBy(key, F.date_trunc("hour", ts).alias("hour_ts")).agg(
        F.sum(value).alias("load"))


def fleet_follow_correlation(readings: DataFrame, key: str = "machine_id", ts: str = "timestamp",
                             value: str = "kwh", lag_hours: int = 1) -> DataFrame:
    """X2, re-aimed without machine pairs: for each machine, the correlation
    between its hourly load and the load of the *rest of the fleet*
    ``lag_hours`` later.

    The fleet series has one row per hour (bounded by the time span), so it
    joins by key.  A machine's own load ``lag_hours`` later comes from a
    range frame over its hourly series -- a per-machine window over at most
    one row per hour, however many readings the machine has."""
    hourly = hourly_load(readings, key, ts, value).withColumn(
        "h", F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', hour_ts)"))
    fleet = hourly.groupBy("h").agg(F.sum("load").alias("fleet_load"))
    w = Window.partitionBy(key).orderBy("h").rangeBetween(lag_hours, lag_hours)
    x = (hourly.withColumn("own_next", F.first("load").over(w))
         .withColumn("h_next", F.col("h") + lag_hours))
    joined = (x.join(sized_broadcast(fleet.withColumnRenamed("h", "h_next")), "h_next")
              .withColumn("others_next", F.col("fleet_load") - F.coalesce("own_next", F.lit(0.0))))
    return joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_hours"),
        F.corr("load", "others_next").alias("follow_corr"))
