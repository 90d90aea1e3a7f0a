"""Aggregations.

All of them are ``groupBy().agg()`` plans: Spark runs a partial aggregate
before the shuffle, so a hot machine costs one partial row per input task,
not one task holding all its readings.  ``percentile_approx`` is a mergeable
sketch for the same reason; an exact percentile would need every value of a
group in one place and is not used on unbounded groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow import constants as K


def machine_kpis(df: DataFrame, key: str = "machine_id", value: str = "kwh",
                 flag: str = "is_anomaly", accuracy: int = 10000) -> DataFrame:
    """A1: count, mean, max, min, stddev, p95, anomaly count and rate (%)."""
    n = F.count(value)
    return df.groupBy(key).agg(
        n.alias("total_readings"),
        F.round(F.mean(value), 2).alias("avg_kwh"),
        F.round(F.max(value), 2).alias("peak_kwh"),
        F.round(F.min(value), 2).alias("min_kwh"),
        F.round(F.stddev(value), 2).alias("std_kwh"),
        F.round(F.percentile_approx(value, 0.95, accuracy), 2).alias("p95_kwh"),
        F.sum(flag).alias("total_anomalies"),
        F.round(F.sum(flag) / n * 100, 2).alias("anomaly_rate_pct"),
    )


def monthly_trends(df: DataFrame, key: str = "machine_id", ts: str = "timestamp",
                   value: str = "kwh", flag: str = "is_anomaly") -> DataFrame:
    """A2: mean, total, peak and anomaly count by machine and month."""
    return df.groupBy(key, F.month(ts).cast("int").alias("month")).agg(
        F.round(F.mean(value), 2).alias("avg_monthly_kwh"),
        F.round(F.sum(value), 2).alias("total_monthly_kwh"),
        F.round(F.max(value), 2).alias("peak_monthly_kwh"),
        F.sum(flag).alias("anomalies_this_month"),
    )


def model_drift(df: DataFrame, key: str = "machine_id", score: str = "z_score",
                limit: float = K.DRIFT_LIMIT) -> DataFrame:
    """A3: spread of the score per machine and a retrain flag (null -> False)."""
    out = df.groupBy(key).agg(
        F.round(F.stddev(score), 4).alias("drift_variance"),
        F.max(score).alias("max_recon_error"),
    )
    return out.withColumn(
        "needs_retrain", F.when(F.col("drift_variance") > limit, F.lit(True)).otherwise(F.lit(False)))


def hourly_forecast(df: DataFrame, key: str = "machine_id", hour: str = "hour",
                    value: str = "kwh", uplift: float = K.FORECAST_UPLIFT) -> DataFrame:
    """A4: ``round(avg(kwh) * 1.05, 2)`` per machine and hour of day."""
    return df.groupBy(key, hour).agg(
        F.round(F.avg(value) * uplift, 2).alias("predicted_load_next_24h"))


def flag_counts(df: DataFrame, flags=("is_anomaly", "spike_flag", "drop_flag", "zscore_flag")) -> DataFrame:
    """A5: all flag totals in one pass (instead of one count job per flag)."""
    names = {"is_anomaly": "anomaly_count", "spike_flag": "spike_count",
             "drop_flag": "drop_count", "zscore_flag": "zscore_count"}
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  *[F.coalesce(F.sum(f), F.lit(0)).cast("long").alias(names.get(f, f"{f}_count"))
                    for f in flags])


def distinct_keys(df: DataFrame, key: str = "machine_id") -> DataFrame:
    """Distinct machines (a grouped, partially aggregated distinct)."""
    return df.select(key).distinct()


def dataset_profile(df: DataFrame, key: str = "machine_id", ts: str = "timestamp",
                    value: str = "kwh") -> DataFrame:
    """Rows, machines, time range, value range and null count, one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(key).alias("n_machines"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.round(F.min(value), 2).alias("min_kwh"),
        F.round(F.max(value), 2).alias("max_kwh"),
        F.sum(F.col(value).isNull().cast("long")).alias("null_kwh"),
    )


def log_summary(df: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    """Scored rows and flagged rows."""
    return df.agg(F.count(F.lit(1)).alias("n_total"),
                  F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0)).alias("n_anomalies"))


def scoring_metrics(df: DataFrame, flag: str = "is_anomaly", alert: str = "alert_sent",
                    latency: str = "latency_ms") -> DataFrame:
    """Requests, anomalies, alerts, anomaly rate (%) and mean latency,
    with ``max(n, 1)`` as divisor so an empty log gives zeros."""
    n = F.count(F.lit(1))
    anomalies = F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0))
    alerts = F.coalesce(F.sum(F.col(alert).cast("long")), F.lit(0))
    lat = F.coalesce(F.sum(latency), F.lit(0.0))
    return df.agg(
        n.alias("total_requests"),
        anomalies.alias("total_anomalies"),
        alerts.alias("total_alerts"),
        F.round(anomalies / F.greatest(n, F.lit(1)) * 100, 2).alias("anomaly_rate_pct"),
        F.round(lat / F.greatest(n, F.lit(1)), 2).alias("avg_latency_ms"),
    )


def error_threshold(df: DataFrame, error: str = "recon_error", by: str | None = None,
                    sigmas: float = K.THRESHOLD_SIGMAS) -> DataFrame:
    """``mean + 3 * population std`` of errors, globally or per key."""
    aggs = [F.avg(error).alias("error_mean"), F.stddev_pop(error).alias("error_std"),
            F.count(error).alias("n_errors")]
    out = df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)
    return out.withColumn("threshold", F.col("error_mean") + sigmas * F.col("error_std"))
