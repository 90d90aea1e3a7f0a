"""Sources and sinks on hand-made files: reordered and missing CSV columns,
malformed timestamps, null and negative readings, absent logs, multi-part
result folders, appends."""

import datetime as dt

from pyspark.sql import functions as F

from meterflow import constants as K
from meterflow.sources import files, sinks
from meterflow.streaming import feed


def _write_text(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1) \
        .write.mode("overwrite").text(path)


def test_csv_by_header_name_and_defaults(spark):
    run = feed.new_run_dir(spark, "test-csv")
    _write_text(spark, f"{run}/in", [
        "kwh,machine_id,timestamp",                 # reordered, most columns missing
        "12.5,3,2024-01-06 10:00:00",
        ",3,2024-01-06 11:00:00",                   # empty -> null kwh (dropped)
        "-1.0,3,2024-01-06 12:00:00",               # negative (dropped)
        "7.0,4,not-a-time",                         # malformed time -> null time
    ])
    out = files.ingest_processed(spark, f"{run}/in").orderBy("machine_id").collect()
    assert [(r.machine_id, r.kwh) for r in out] == [(3, 12.5), (4, 7.0)]
    first = out[0]
    assert first.timestamp == dt.datetime(2024, 1, 6, 10, 0)
    assert first.air_temperature == 20.0 and first.hour == 10
    assert first.dayofweek == 5 and first.is_weekend == 1    # Saturday, Monday = 0
    assert out[1].timestamp is None


def test_fallback_source(spark):
    run = feed.new_run_dir(spark, "test-fallback")
    _write_text(spark, f"{run}/fallback", ["timestamp,machine_id,kwh,air_temperature",
                                           "2024-01-01 00:00:00,0,5.0,18.5"])
    df = files.ingest_processed(spark, f"{run}/missing", fallback=f"{run}/fallback")
    row = df.first()
    assert row.kwh == 5.0 and row.air_temperature == 18.5    # by name, not position


def test_absent_log_is_empty(spark):
    df = files.read_log(spark, "/nonexistent/meterflow/log", "machine_id bigint, is_anomaly int")
    assert df.count() == 0 and df.columns == ["machine_id", "is_anomaly"]


def test_result_dir_reads_every_part(spark):
    run = feed.new_run_dir(spark, "test-parts")
    df = spark.range(100).select(F.col("id").alias("machine_id"), (F.col("id") * 1.5).alias("avg_kwh"))
    sinks.save_result_csv(df.repartition(4), f"{run}/kpis")
    back = files.read_result_dir(spark, f"{run}/kpis", "machine_id bigint, avg_kwh double")
    assert back.count() == 100


def test_append_never_truncates(spark):
    run = feed.new_run_dir(spark, "test-append")
    cols = ", ".join(f"{c} string" for c in K.EDGE_LOG_COLUMNS)
    a = spark.createDataFrame([tuple(str(i) for i in range(7))], cols)
    sinks.append_log(a, f"{run}/log")
    sinks.append_log(a, f"{run}/log")
    assert files.read_log(spark, f"{run}/log", cols, fmt="parquet").count() == 2


def test_partitioned_table_and_predictions_and_alerts(spark):
    run = feed.new_run_dir(spark, "test-sinks")
    df = spark.createDataFrame(
        [(1, dt.datetime(2024, m, 1), 10.0 * m, 9.0 * m, m % 2) for m in range(1, 7)],
        "machine_id bigint, timestamp timestamp_ntz, kwh double, prediction double, is_anomaly int")
    sinks.write_table(df.withColumn("month", F.month("timestamp")), f"{run}/t", partition_by=["month"])
    pruned = spark.read.parquet(f"{run}/t").filter("month = 3")
    assert "PartitionFilters: [isnotnull(month" in pruned._jdf.queryExecution().executedPlan().toString()
    assert pruned.count() == 1
    sinks.write_predictions(df, f"{run}/pred")
    assert files.read_result_dir(spark, f"{run}/pred", "machine_id bigint, timestamp string, "
                                 "kwh double, prediction double, is_anomaly int").count() == 6
    scored = spark.createDataFrame(
        [(1, True, "r1", "{}", dt.datetime(2024, 1, 1)), (2, False, "No threshold crossed", "{}",
                                                           dt.datetime(2024, 1, 1))],
        "machine_id bigint, alert_fired boolean, alert_reason string, payload string, "
        "request_ts timestamp_ntz")
    sinks.write_alerts(scored, f"{run}/alerts")
    assert [r.machine_id for r in spark.read.parquet(f"{run}/alerts").collect()] == [1]
