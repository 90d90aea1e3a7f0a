"""Sinks (S5-S8, S12, S13).

Writers never collect to the driver.  ``single_file`` (``coalesce(1)``) is
available for small result tables only; by default every task writes its own
part file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """Write a table (parquet by default), optionally partitioned so
    later reads can prune folders."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)
    return path


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Write ``df`` as a table of ``buckets`` buckets by ``keys``, one sorted
    file each, and return the table.  Tables with the same keys and number of
    buckets join on them without an exchange, however often they are read.
    ``buckets`` (default: the shuffle partitions) should make a bucket fit one
    task; a key with very many rows fills its bucket, so bucket by a composite
    key where single columns are skewed."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"meterflow_{uuid.uuid4().hex}"
    (df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
    return spark.table(name)


def save_result_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Overwrite a result as headed CSV (one file only on request)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_predictions(df: DataFrame, path: str,
                      cols=("machine_id", "timestamp", "kwh", "prediction", "is_anomaly")) -> str:
    """Predictions with their anomaly context, CSV, one file per task."""
    return save_result_csv(df.select(*cols), path)


def append_log(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Append scored rows to a log table (never truncates)."""
    w = df.write.mode("append").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)
    return path


def alert_records(df: DataFrame) -> DataFrame:
    """Alert rows as records for an outbound queue or table; delivery
    itself is outside Spark."""
    return df.filter(F.col("alert_fired")).select(
        "machine_id", F.col("request_ts").alias("timestamp"), "alert_reason", "payload")


def write_alerts(df: DataFrame, path: str) -> str:
    """Append alert records (batch or inside ``foreachBatch``)."""
    return append_log(alert_records(df), path)


def save_model(frame: DataFrame, path: str) -> str:
    """A model bundle (one-row parameter table) as parquet."""
    frame.write.mode("overwrite").parquet(path)
    return path
