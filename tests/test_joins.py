"""Enrichment joins: whole tables, bucketed tables without an exchange, the meter filter."""

import datetime as dt

from pyspark.sql import functions as F

from meterflow.operators import prep
from meterflow.sources import sinks
from meterflow.streaming import feed

DAY = dt.datetime(2024, 1, 1)


def _fact(spark):
    rows = [(i % 7, i % 3 if i % 11 else None, DAY + dt.timedelta(days=i % 5), float(i), i) for i in range(200)]
    return spark.createDataFrame(rows, "building_id int, site_id int, timestamp timestamp_ntz, kwh double, reading_id long")


def _weather(spark):
    rows = [(s, DAY + dt.timedelta(days=d), s * 10.0 + d) for s in range(3) for d in range(4)]
    return spark.createDataFrame(rows, "site_id int, timestamp timestamp_ntz, air_temperature double")


def test_bucketed_tables_join_without_an_exchange(spark):
    run, keys = feed.new_run_dir(spark, "test-bucketed"), ["site_id", "timestamp"]
    fact = sinks.write_bucketed(_fact(spark), f"{run}/fact", keys, buckets=5)
    weather = sinks.write_bucketed(_weather(spark), f"{run}/weather", keys, buckets=5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = prep.with_weather(fact, weather)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        plain = prep.with_weather(_fact(spark), _weather(spark))
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # every reading stays, those without site or weather too
    assert joined.count() == 200
    assert joined.where("air_temperature is null").count() == sum(
        1 for i in range(200) if i % 11 == 0 or i % 5 == 4)
    assert spark.read.parquet(f"{run}/fact").count() == 200


def test_bucketed_metadata_join_without_an_exchange(spark):
    run = feed.new_run_dir(spark, "test-bucketed-meta")
    meta = spark.createDataFrame([(i, f"use{i}") for i in range(5)], "building_id int, primary_use string")
    fact = sinks.write_bucketed(_fact(spark), f"{run}/fact", ["building_id"], buckets=4)
    dims = sinks.write_bucketed(meta, f"{run}/meta", ["building_id"], buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = fact.join(dims, "building_id", "left")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.where("primary_use is null").count() == _fact(spark).where("building_id >= 5").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_meter_filter_reaches_the_scan(spark):
    run = feed.new_run_dir(spark, "test-meter")
    spark.range(100).select((F.col("id") % 4).alias("meter"), F.col("id").alias("building_id")).write.parquet(f"{run}/raw")
    kept = prep.readings_filter(spark.read.parquet(f"{run}/raw"), meter=0, keys=[0, 4, 8, 9])
    assert sorted(r.building_id for r in kept.collect()) == [0, 4, 8]
    assert "EqualTo(meter,0)" in kept._jdf.queryExecution().executedPlan().toString()
