"""End-to-end jobs a user runs, composed from the operators.

| job | what it does |
|---|---|
| ``prepare`` | raw readings + metadata + weather -> processed readings table |
| ``train`` | processed readings -> scaled windows -> bottleneck model + thresholds + edge log |
| ``analytics`` | processed readings -> features, flags, KPIs, monthly trends, drift, forecast, GBT |
| ``score_feed`` | a folder of arriving readings -> scored log + anomaly events (Structured Streaming) |

Command line: ``python -m meterflow.jobs <job> --help``.  Outputs are
written with the sinks in ``meterflow.sources.sinks``; nothing is collected
to the driver except model parameters and bounded summaries.
"""

from __future__ import annotations

import argparse
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from meterflow import bundle
from meterflow.operators import forecast, prep, rollups, rules, sequence, windows
from meterflow.sources import files, sinks
from meterflow.streaming import feed

META_SCHEMA = ("site_id int, building_id int, primary_use string, square_feet int, "
               "year_built double, floor_count double")
WEATHER_SCHEMA = ("site_id int, timestamp string, air_temperature double, cloud_coverage double, "
                  "dew_temperature double, precip_depth_1_hr double, sea_level_pressure double, "
                  "wind_direction double, wind_speed double")


def prepare(spark: SparkSession, raw_path: str, meta_path: str, weather_path: str, out: str,
            machines: list[int] | None = None, meter: int = 0) -> str:
    """S1/S2 + P1/P2 + J1/J2 + P5 + P4 + S5: the processed readings table,
    partitioned by month."""
    raw = files.read_raw_readings(spark, raw_path, meter=meter, machines=machines)
    meta = files.read_dimension(spark, meta_path, META_SCHEMA)
    if machines:
        meta = meta.filter(F.col("building_id").isin(machines))
    weather = files.read_dimension(spark, weather_path, WEATHER_SCHEMA)
    df = prep.enrich(raw, meta, weather)
    df = df.withColumn("timestamp", F.expr("try_cast(`timestamp` AS TIMESTAMP_NTZ)"))
    df = df.transform(prep.add_calendar).transform(prep.rename_raw)
    return sinks.write_table(df, out, partition_by=["month"])


def processed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Processed readings from parquet (as written by ``prepare``) or CSV."""
    if fmt == "csv":
        return files.ingest_processed(spark, path)
    return prep.valid_readings(spark.read.parquet(path))


def train(spark: SparkSession, readings: DataFrame, out: str, per_machine: bool = False) -> dict:
    """M7/M9 + A10 + A11 + W4 + S13: fit the bottleneck (one, or one a machine)
    on the training windows, set thresholds on the validation windows, save the
    whole bundle and append the held-out tail's scores to the edge log."""
    order_col = "reading_id" if "reading_id" in readings.columns else None
    frames = sequence.training_frames(readings, tiebreak=order_col)
    wins = sequence.frame_windows(frames)
    train_w = wins.filter(F.col("split") == "train")
    fitted = bundle.Bundle(out, "", bounds=sequence.fit_minmax(readings))
    if per_machine:
        fitted.models = sequence.fit_machine_pca(train_w).persist(StorageLevel.MEMORY_AND_DISK)
    else:
        fitted.scorer = sequence.fit_pca_scorer(train_w)
    limits = sequence.thresholds(fitted.score(wins, arr="readings"))
    bundle.save(spark, out, bounds=fitted.bounds, thresholds=limits, scorer=fitted.scorer, models=fitted.models)
    if per_machine:
        fitted.models.unpersist()
    saved = bundle.load(spark, out)
    tail = saved.score(sequence.frame_tail(frames), arr="readings")
    sinks.append_log(sequence.edge_log_of(tail, saved.thresholds), f"{out}/edge_log")
    return {"model": bundle.part_path(spark, out, "models" if per_machine else "model"),
            "thresholds": bundle.part_path(spark, out, "thresholds"), "edge_log": f"{out}/edge_log"}


def analytics(spark: SparkSession, readings: DataFrame, out: str, with_model: bool = True) -> dict:
    """The batch analytics job: W1/W2 -> R1-R5 -> A1, A2, A3, A4, A5 -> M1-M6
    -> S6/S7 result folders."""
    order_col = "reading_id" if "reading_id" in readings.columns else None
    flagged = (readings.transform(windows.window_features, tiebreak=order_col)
               .transform(rules.add_anomaly_flags).transform(prep.fill_missing_columns))
    paths = {}
    for name, df in {
        "machine_kpis": rollups.machine_kpis(flagged).orderBy("machine_id"),
        "monthly_trends": rollups.monthly_trends(flagged).orderBy("machine_id", "month"),
        "drift": rollups.model_drift(flagged),
        "hourly_forecast": rollups.hourly_forecast(flagged).orderBy("machine_id", "hour"),
        "flag_counts": rollups.flag_counts(flagged),
        "anomalies_flagged": flagged.filter(F.col("is_anomaly") == 1).select(
            "machine_id", "timestamp", "kwh", "rolling_avg_24h", "z_score", "spike_flag",
            "drop_flag"),
    }.items():
        paths[name] = sinks.save_result_csv(df, f"{out}/{name}")
    if with_model:
        keys = ["machine_id", order_col] if order_col else ["machine_id", "timestamp"]
        train_df, test_df = forecast.hash_split(prep.drop_incomplete(flagged), keys)
        try:
            model = forecast.fit_forecaster(train_df)
        except ValueError as short:                  # the other results are whole without it
            warnings.warn(f"no forecast: {short}")
            return paths
        bundle.save(spark, f"{out}/forecast_model", forecaster=model)
        pred = model.transform(test_df)
        paths["gbt_predictions"] = sinks.write_predictions(pred, f"{out}/gbt_predictions")
        paths["gbt_metrics"] = sinks.save_result_csv(forecast.regression_metrics(pred), f"{out}/gbt_metrics")
        paths["feature_importance"] = sinks.save_result_csv(
            forecast.feature_importance(spark, model), f"{out}/feature_importance")
        paths["forecast_model"] = f"{out}/forecast_model"
    return paths


def score_feed(spark: SparkSession, feed_dir: str, model_dir: str, out: str) -> dict:
    """T1-T4 over a folder of arriving reading files, with a saved bundle: its
    bounds, its thresholds and its bottleneck, be it one or one a machine.  Runs
    what is available, then stops; run it again (same ``out``) to continue from
    the checkpoint."""
    models = bundle.load(spark, model_dir)
    stream = prep.valid_readings(feed.read_feed(spark, feed_dir), strictly_positive=True)
    scored = feed.score_stream(feed.window_stream(stream), models.bounds, models.thresholds, models.score)
    feed.run_available(scored.writeStream.foreachBatch(
        feed.log_and_events_writer(f"{out}/log", f"{out}/events")), f"{out}/checkpoint")
    return {"log": f"{out}/log", "events": f"{out}/events"}


def main(argv: list[str] | None = None) -> None:
    from meterflow.session import build_session

    ap = argparse.ArgumentParser(prog="meterflow.jobs")
    sub = ap.add_subparsers(dest="job", required=True)
    p = sub.add_parser("prepare")
    p.add_argument("--raw", required=True)
    p.add_argument("--meta", required=True)
    p.add_argument("--weather", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--machines", type=lambda s: [int(x) for x in s.split(",")])
    t = sub.add_parser("train")
    t.add_argument("--readings", required=True)
    t.add_argument("--out", required=True)
    t.add_argument("--per-machine", action="store_true")
    t.add_argument("--format", default="parquet")
    a = sub.add_parser("analytics")
    a.add_argument("--readings", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--no-model", action="store_true")
    a.add_argument("--format", default="parquet")
    s = sub.add_parser("score")
    s.add_argument("--feed", required=True)
    s.add_argument("--model", required=True)
    s.add_argument("--out", required=True)
    args = ap.parse_args(argv)

    spark = build_session(master=None)
    if args.job == "prepare":
        print(prepare(spark, args.raw, args.meta, args.weather, args.out, args.machines))
    elif args.job == "train":
        print(train(spark, processed(spark, args.readings, args.format), args.out, args.per_machine))
    elif args.job == "analytics":
        print(analytics(spark, processed(spark, args.readings, args.format), args.out,
                        not args.no_model))
    else:
        print(score_feed(spark, args.feed, args.model, args.out))
    spark.stop()


if __name__ == "__main__":
    main()
