"""The four end-to-end jobs on files made from the sf0.001 tables."""

import pytest
from pyspark.sql import functions as F

from meterflow import bundle, jobs
from meterflow.operators import sequence, windows
from meterflow.sources import fixtures as fx
from meterflow.streaming import feed
from tests.conftest import SF_SMALL


def test_prepare_analytics_train_score(spark):
    run = feed.new_run_dir(spark, "test-jobs")
    raw = fx.raw_readings_from_orders(spark, SF_SMALL).select(
        F.col("building_id").cast("int"), "meter",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "meter_reading")
    raw.write.option("header", True).csv(f"{run}/raw")
    meta = fx.metadata_from_customer(spark, SF_SMALL).select(
        "site_id", F.col("building_id").cast("int"), "primary_use")
    meta.write.option("header", True).csv(f"{run}/meta")
    weather = fx.weather_from_lineitem(spark, SF_SMALL).select(
        "site_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "air_temperature", "wind_speed", "sea_level_pressure")
    weather.write.option("header", True).csv(f"{run}/weather")

    out = jobs.prepare(spark, f"{run}/raw", f"{run}/meta", f"{run}/weather", f"{run}/processed")
    processed = jobs.processed(spark, out)
    assert processed.count() == raw.filter("meter = 0").count()
    assert {"machine_id", "kwh", "site_id", "air_temperature", "hour", "month"} <= set(processed.columns)

    # five machines give series long enough for a held-out tail at this scale
    readings = fx.readings_from_orders(spark, SF_SMALL, machines=5)
    paths = jobs.analytics(spark, readings, f"{run}/analytics")
    kpis = spark.read.option("header", True).csv(paths["machine_kpis"])
    assert kpis.count() == readings.select("machine_id").distinct().count()
    assert "gbt_metrics" in paths

    trained = jobs.train(spark, readings, f"{run}/model")
    assert spark.read.parquet(trained["thresholds"]).count() > 0
    assert spark.read.parquet(trained["edge_log"]).count() > 0

    src = feed.replay_folder(spark, readings)
    scored = jobs.score_feed(spark, src, f"{run}/model", f"{run}/live")
    n = readings.groupBy("machine_id").count().agg(
        F.sum(F.greatest(F.col("count") - 23, F.lit(0)))).first()[0]
    assert feed.read_table(spark, scored["log"], feed.LOG_SCHEMA).count() == n


def test_train_and_score_per_machine(spark):
    """M9 on a feed: the stream's errors equal the batch scores of the same windows."""
    run = feed.new_run_dir(spark, "test-jobs-m9")
    readings = fx.readings_from_orders(spark, SF_SMALL, machines=5)
    trained = jobs.train(spark, readings, f"{run}/model", per_machine=True)
    models = bundle.load(spark, f"{run}/model")
    assert models.scorer is None and models.models.count() == models.bounds.count() == 5
    edge = spark.read.parquet(trained["edge_log"])
    assert edge.count() > 0 and edge.where("recon_error is null or threshold is null").count() == 0

    src = feed.replay_folder(spark, readings)
    scored = jobs.score_feed(spark, src, f"{run}/model", f"{run}/live")
    log = feed.read_table(spark, scored["log"], feed.LOG_SCHEMA)
    scaled = sequence.apply_minmax(readings, models.bounds)
    wins = windows.trailing_windows(scaled.drop("kwh").withColumnRenamed("scaled", "kwh"))
    batch = models.score(wins, arr="readings").select(
        "machine_id", F.col("_ord").alias("end_ord"), F.round("recon_error", 6).alias("recon_error"))
    want = {(r.machine_id, r.end_ord): r.recon_error for r in batch.collect()}
    got = {(r.machine_id, r.end_ord): r.recon_error for r in log.collect()}
    assert len(got) == log.count() > 0 and got == want
    flagged = {(r.machine_id, r.end_ord) for r in log.where("recon_error > threshold").collect()}
    events = feed.read_table(spark, scored["events"], feed.LOG_SCHEMA)
    assert flagged == {(r.machine_id, r.end_ord) for r in events.collect()}


def test_a_short_table_gets_no_forecast(spark):
    run = feed.new_run_dir(spark, "test-jobs-short")
    short = fx.readings_from_orders(spark, SF_SMALL, machines=5).where("machine_id = 1").limit(60)
    with pytest.warns(UserWarning, match="no forecast"):
        paths = jobs.analytics(spark, short, f"{run}/out")
    assert "machine_kpis" in paths and "gbt_metrics" not in paths


def test_cli_analytics(spark, monkeypatch):
    import meterflow.session as session
    run = feed.new_run_dir(spark, "test-cli")
    fx.readings_from_orders(spark, SF_SMALL, machines=5).write.parquet(f"{run}/readings")
    monkeypatch.setattr(session, "build_session", lambda **kw: spark)
    monkeypatch.setattr(spark, "stop", lambda: None)
    jobs.main(["analytics", "--readings", f"{run}/readings", "--out", f"{run}/out", "--no-model"])
    kpis = spark.read.option("header", True).csv(f"{run}/out/machine_kpis")
    assert kpis.count() == 5
