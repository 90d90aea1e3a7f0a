"""Adapters from the driver tables to the readings data model.

The readings model is ``machine_id, timestamp, kwh`` plus a unique
``reading_id`` used as the tie-break inside a machine's time order.

| role | table | mapping |
|---|---|---|
| readings | events | user_id -> machine_id, ts -> timestamp, value -> kwh, event_id -> reading_id |
| multi-month readings | orders | o_custkey % 50 -> machine_id, o_orderdate -> timestamp, o_totalprice -> kwh |
| enrichment readings | orders | o_custkey -> machine_id (matches customer keys) |
| raw readings | orders | o_custkey -> building_id, priority digit - 1 -> meter, o_orderdate -> timestamp, o_totalprice -> meter_reading |
| metadata | customer | c_custkey -> machine_id, c_nationkey -> site_id, c_mktsegment -> primary_use |
| weather | lineitem x supplier | daily means by (s_nationkey, l_shipdate) |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READING_COLS = ["machine_id", "timestamp", "kwh", "reading_id"]
MONTHLY_MACHINES = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def readings_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("machine_id"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("kwh"),
        F.col("event_id").alias("reading_id"),
    )


def readings_from_orders(spark: SparkSession, sf_dir: str,
                         machines: int = MONTHLY_MACHINES) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % machines).alias("machine_id"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_totalprice").alias("kwh"),
        F.col("o_orderkey").alias("reading_id"),
    )


def raw_readings_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-reading shape (building_id, meter, timestamp, meter_reading)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("building_id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("meter"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_totalprice").alias("meter_reading"),
        F.col("o_orderkey").alias("reading_id"),
    )


def metadata_from_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("building_id"),
        F.col("c_nationkey").alias("site_id"),
        F.col("c_mktsegment").alias("primary_use"),
    )


def weather_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily site weather: means of lineitem measures per (nation, ship day)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        li.join(su, li.l_suppkey == su.s_suppkey)
        .groupBy(F.col("s_nationkey").alias("site_id"),
                 F.col("l_shipdate").alias("timestamp"))
        .agg(F.round(F.avg("l_quantity"), 6).alias("air_temperature"),
             F.round(F.avg("l_discount"), 6).alias("wind_speed"),
             F.round(F.avg("l_tax"), 6).alias("sea_level_pressure"))
    )
