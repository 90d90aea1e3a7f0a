"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (through ``sources.fixtures``) and runs
over them whole.  Float outputs are rounded (6 decimals unless the reference
rounds to fewer) so results compare exactly with the DuckDB oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow import bundle
from meterflow import constants as K
from meterflow.operators import (events, forecast, insights, prep, rollups, rules, sequence,
                                 windows)
from meterflow.sources import files, sinks
from meterflow.sources import fixtures as fx
from meterflow.streaming import feed, slots

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Queries with no SQL equivalent (fits of boosted trees); the driver
# checks their rows only, and tests compare the scorers with brute force.
ROWS_ONLY: list[str] = []


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


# --- step 1: features, rules, KPIs --------------------------------------------

def flagged_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events readings -> window features -> anomaly flags."""
    return fx.readings_from_events(spark, sf_dir).transform(windows.window_features).transform(
        rules.add_anomaly_flags)


@register("window_features")
def q_window_features(spark, sf_dir):
    df = fx.readings_from_events(spark, sf_dir).transform(windows.window_features)
    return df.select("machine_id", "timestamp", "kwh", "reading_id", "lag_1h", "lag_24h",
                     r6("rolling_avg_24h"), r6("rolling_std_24h"),
                     "rolling_max_24h", "rolling_min_24h")


@register("anomaly_flags")
def q_anomaly_flags(spark, sf_dir):
    return flagged_readings(spark, sf_dir).select(
        "machine_id", "timestamp", "kwh", "reading_id", r6("z_score"),
        "spike_flag", "drop_flag", "zscore_flag", "is_anomaly")


@register("machine_kpis")
def q_machine_kpis(spark, sf_dir):
    # O2: rollups come ordered by their keys (a small output)
    return rollups.machine_kpis(flagged_readings(spark, sf_dir)).orderBy("machine_id")


# --- step 2: rollups ---------------------------------------------------------------

def flagged_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.readings_from_orders(spark, sf_dir).transform(windows.window_features).transform(
        rules.add_anomaly_flags)


@register("monthly_trends")
def q_monthly_trends(spark, sf_dir):
    return rollups.monthly_trends(flagged_monthly(spark, sf_dir)).orderBy("machine_id", "month")


@register("drift")
def q_drift(spark, sf_dir):
    out = rollups.model_drift(flagged_readings(spark, sf_dir))
    return out.select("machine_id", "drift_variance", r6("max_recon_error"), "needs_retrain")


@register("hourly_forecast")
def q_hourly_forecast(spark, sf_dir):
    df = flagged_readings(spark, sf_dir).transform(prep.add_calendar)
    return rollups.hourly_forecast(df).orderBy("machine_id", "hour")


@register("flag_counts")
def q_flag_counts(spark, sf_dir):
    return rollups.flag_counts(flagged_readings(spark, sf_dir))


@register("dataset_profile")
def q_dataset_profile(spark, sf_dir):
    return rollups.dataset_profile(fx.readings_from_events(spark, sf_dir))


@register("distinct_machines")
def q_distinct_machines(spark, sf_dir):
    return rollups.distinct_keys(fx.readings_from_events(spark, sf_dir))


# --- step 3: preparation and joins ----------------------------------------------------

TARGET_SEGMENT = "MACHINERY"


def target_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = fx.metadata_from_customer(spark, sf_dir)
    return meta.filter(F.col("primary_use") == TARGET_SEGMENT).select("building_id")


@register("scan_filter")
def q_scan_filter(spark, sf_dir):
    raw = fx.raw_readings_from_orders(spark, sf_dir)
    return prep.readings_filter(raw, meter=0, keys=target_machines(spark, sf_dir))


@register("enrich_left_joins")
def q_enrich_left_joins(spark, sf_dir):
    return enriched_result(prep.enrich(
        fx.raw_readings_from_orders(spark, sf_dir), fx.metadata_from_customer(spark, sf_dir),
        fx.weather_from_lineitem(spark, sf_dir)))


def enriched_result(df: DataFrame) -> DataFrame:
    out = df.transform(prep.rename_raw).transform(prep.add_calendar)
    return out.select("machine_id", "timestamp", "kwh", "reading_id", "site_id", "primary_use",
                      "air_temperature", "wind_speed", "sea_level_pressure",
                      "hour", "month", "dayofweek", "is_weekend", "date")


@register("enrich_bucketed")
def q_enrich_bucketed(spark, sf_dir):
    """J1 + J2 over tables bucketed by their join keys: the weather join reads
    both sides where they lie, without an exchange."""
    sited = prep.with_metadata(fx.raw_readings_from_orders(spark, sf_dir), fx.metadata_from_customer(spark, sf_dir))
    keys = ["site_id", "timestamp"]
    fact = sinks.write_bucketed(sited, _scratch(spark, "sited-readings"), keys)
    weather = sinks.write_bucketed(fx.weather_from_lineitem(spark, sf_dir), _scratch(spark, "weather"), keys)
    return enriched_result(prep.with_weather(fact, weather))


@register("calendar_features")
def q_calendar_features(spark, sf_dir):
    return fx.readings_from_events(spark, sf_dir).transform(prep.add_calendar)


@register("fill_missing_columns")
def q_fill_missing_columns(spark, sf_dir):
    return fx.readings_from_events(spark, sf_dir).transform(prep.fill_missing_columns)


@register("dropna_subset")
def q_dropna_subset(spark, sf_dir):
    df = (fx.readings_from_events(spark, sf_dir).transform(prep.fill_missing_columns)
          .transform(windows.window_features).transform(prep.drop_incomplete))
    return df.select("machine_id", "timestamp", "kwh", "reading_id", "lag_1h", "lag_24h",
                     r6("rolling_avg_24h"))


@register("union_sources")
def q_union_sources(spark, sf_dir):
    return prep.union_sources(fx.readings_from_events(spark, sf_dir),
                              fx.readings_from_orders(spark, sf_dir))


@register("expected_baseline")
def q_expected_baseline(spark, sf_dir):
    df = fx.readings_from_events(spark, sf_dir).transform(prep.add_expected_load)
    return df.select("machine_id", "timestamp", "kwh", "reading_id", r6("expected_kwh"))


# --- step 4: sequences, scaling, scoring -------------------------------------------

def window_summary(df: DataFrame, arr: str = "readings") -> list:
    a = F.col(arr)
    add = lambda acc, x: acc + x
    return [
        F.size(a).alias("seq_len"),
        F.element_at(a, 1).alias("seq_first"),
        F.element_at(a, -1).alias("seq_last"),
        F.round(F.aggregate(a, F.lit(0.0), add), 6).alias("seq_sum"),
        F.round(F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), add),
                6).alias("seq_weighted"),
    ]


@register("minmax_scale")
def q_minmax_scale(spark, sf_dir):
    r = fx.readings_from_orders(spark, sf_dir)
    out = sequence.apply_minmax(r, sequence.fit_minmax(r))
    return out.select("machine_id", "timestamp", "kwh", "reading_id", "scale_min", "scale_max",
                      r6("scaled"))


@register("sequence_windows")
def q_sequence_windows(spark, sf_dir):
    w = windows.sequence_windows(fx.readings_from_events(spark, sf_dir))
    return w.select("machine_id", "window_start", "window_start_ts", "window_end_ts",
                    *window_summary(w))


@register("chrono_split")
def q_chrono_split(spark, sf_dir):
    w = sequence.scaled_windows(fx.readings_from_orders(spark, sf_dir))
    return w.select("machine_id", "window_start", "n_windows", "split")


@register("edge_windows")
def q_edge_windows(spark, sf_dir):
    w = windows.edge_windows(fx.readings_from_orders(spark, sf_dir))
    return w.select("machine_id", "hour_index", "timestamp_last", "kwh_last", *window_summary(w))


def deviation_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = sequence.scaled_windows(fx.readings_from_orders(spark, sf_dir))
    return sequence.score(w, sequence.DeviationScorer())


@register("baseline_scores")
def q_baseline_scores(spark, sf_dir):
    return deviation_scored(spark, sf_dir).select(
        "machine_id", "window_start", "split", r6("recon_error"))


@register("baseline_threshold")
def q_baseline_threshold(spark, sf_dir):
    t = sequence.thresholds(deviation_scored(spark, sf_dir))
    return t.select("machine_id", r6("error_mean"), r6("error_std"), "n_errors", r6("threshold"))


@register("baseline_edge_log")
def q_baseline_edge_log(spark, sf_dir):
    frames = sequence.training_frames(fx.readings_from_orders(spark, sf_dir))
    scorer = sequence.DeviationScorer()
    limits = sequence.thresholds(sequence.score(sequence.frame_windows(frames), scorer))
    return sequence.edge_log_from(frames, scorer, limits)


def pca_scored(spark: SparkSession, sf_dir: str):
    w = sequence.scaled_windows(fx.readings_from_orders(spark, sf_dir))
    scorer = sequence.fit_pca_scorer(w.filter(F.col("split") == "train"))
    return sequence.score(w, scorer), scorer


@register("recon_scores")
def q_recon_scores(spark, sf_dir):
    scored, _ = pca_scored(spark, sf_dir)
    return scored.select("machine_id", "window_start", "split", r6("recon_error"))


@register("recon_scores_long")
def q_recon_scores_long(spark, sf_dir):
    """M8 as a product of tables: same errors as the vectorised scorer."""
    w = sequence.scaled_windows(fx.readings_from_orders(spark, sf_dir))
    scorer = sequence.fit_pca_scorer(w.filter(F.col("split") == "train"))
    scored = sequence.score_long(w, *sequence.model_long(spark, scorer))
    return scored.select("machine_id", "window_start", "split", r6("recon_error"))


@register("model_threshold")
def q_model_threshold(spark, sf_dir):
    scored, _ = pca_scored(spark, sf_dir)
    t = sequence.thresholds(scored)
    return t.select("machine_id", r6("error_mean"), r6("error_std"), "n_errors", r6("threshold"))


@register("edge_scores")
def q_edge_scores(spark, sf_dir):
    frames = sequence.training_frames(fx.readings_from_orders(spark, sf_dir))
    wins = sequence.frame_windows(frames)
    scorer = sequence.fit_pca_scorer(wins.filter(F.col("split") == "train"))
    limits = sequence.thresholds(sequence.score(wins, scorer))
    return sequence.edge_log_from(frames, scorer, limits)


# --- step 5: requests, alerts, logs and feeds ----------------------------------------

@register("validate_requests")
def q_validate_requests(spark, sf_dir):
    req = events.validate_requests(events.request_frames(fx.readings_from_events(spark, sf_dir)))
    return req.select("machine_id", "window_start", F.size("readings").alias("n_values"),
                      "is_valid", "rejection")


def scored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid 24-reading requests from the orders readings, forecast from the
    hourly rollup, scaled with the machine's bounds, scored and decided.
    Requests and the thresholds' validation windows come from one window
    pass (``scoring_frames``)."""
    r = fx.readings_from_orders(spark, sf_dir)
    frames = sequence.scoring_frames(r)
    scorer = sequence.DeviationScorer()
    # validation windows are full windows; reading the raw array here too keeps
    # both branches on the same frame columns, so Spark reuses one shuffle
    full = F.col("split").isNotNull() & (F.size("readings") == K.WINDOW)
    limits = sequence.thresholds(sequence.score(frames.filter(full), scorer, arr="scaled_readings"))
    req = frames.withColumn("predicted_kwh", F.element_at("readings", -1) * K.FORECAST_UPLIFT)
    req = events.validate_requests(req).filter("is_valid")
    fc = rollups.hourly_forecast(r.transform(prep.add_calendar)).withColumnRenamed(
        "predicted_load_next_24h", "forecast_kwh")
    req = (req.withColumn("hour", F.hour("request_ts").cast("int"))
           .join(prep.sized_broadcast(fc), ["machine_id", "hour"], "left")
           .withColumn("predicted_kwh", F.col("forecast_kwh")))
    req = sequence.score(req, scorer, arr="scaled_readings")
    req = events.attach_limits(req, limits)
    return events.decide_alerts(req)


def scored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.prediction_log(scored_requests(spark, sf_dir))


LOG_ORDER = ("machine_id", "actual_kwh", "predicted_kwh", "recon_error", "threshold")


@register("alert_decision")
def q_alert_decision(spark, sf_dir):
    return scored_requests(spark, sf_dir).select(
        "machine_id", "window_start", "is_anomaly", "alert_fired", "alert_reason")


@register("alert_json")
def q_alert_json(spark, sf_dir):
    fired = scored_requests(spark, sf_dir).filter("alert_fired")
    return events.alert_document(fired).select("machine_id", "window_start", "payload")


@register("prediction_log")
def q_prediction_log(spark, sf_dir):
    return scored_log(spark, sf_dir)


@register("scoring_metrics")
def q_scoring_metrics(spark, sf_dir):
    return rollups.scoring_metrics(scored_log(spark, sf_dir))


@register("recent_anomalies")
def q_recent_anomalies(spark, sf_dir):
    return events.recent_anomalies(scored_log(spark, sf_dir), order=LOG_ORDER)


@register("recent_anomalies_of_machine")
def q_recent_anomalies_of_machine(spark, sf_dir):
    return events.recent_anomalies(scored_log(spark, sf_dir), machine_id=0, order=LOG_ORDER)


@register("newest_feed")
def q_newest_feed(spark, sf_dir):
    flagged = scored_log(spark, sf_dir).filter(F.col("is_anomaly") == 1)
    return events.newest_feed(flagged, order=LOG_ORDER)


@register("last_n_per_machine")
def q_last_n_per_machine(spark, sf_dir):
    return windows.last_n_per_key(fx.readings_from_orders(spark, sf_dir), 200)


def registered_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.readings_from_events(spark, sf_dir).select("machine_id")


@register("machine_status")
def q_machine_status(spark, sf_dir):
    log = scored_log(spark, sf_dir)
    return events.latest_state(log, registered_machines(spark, sf_dir),
                               order=("actual_kwh", "recon_error"))


@register("rate_band")
def q_rate_band(spark, sf_dir):
    return events.label_rates(q_machine_kpis(spark, sf_dir))


def relay_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relay messages from the log: a data point per row and an alarm per
    flagged row (with readings for machines of even id), emitted together from
    one pass (``explode``)."""
    log = scored_log(spark, sf_dir)
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    point = F.to_json(F.struct(
        "machine_id", F.col("actual_kwh").alias("kwh"), "recon_error", "threshold",
        (F.col("is_anomaly") == 1).alias("is_anomaly"), iso.alias("timestamp")))
    alarm = F.when(F.col("is_anomaly") == 1, F.to_json(F.struct(
        F.lit(K.ALARM_TYPE).alias("type"), "machine_id",
        F.round("recon_error", 4).alias("error"), iso.alias("timestamp"),
        F.when(F.col("machine_id") % 2 == 0, F.array(F.lit(1.0), F.col("actual_kwh"))).alias("readings"))))
    msgs = F.filter(F.array(point, alarm), lambda m: m.isNotNull())
    return log.select(F.explode(msgs).alias("message"))


@register("normalise_events")
def q_normalise_events(spark, sf_dir):
    return events.normalise_messages(relay_messages(spark, sf_dir))


def valid_orders_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = events.request_frames(fx.readings_from_orders(spark, sf_dir))
    return events.validate_requests(req).filter("is_valid")


@register("what_if_scale")
def q_what_if_scale(spark, sf_dir):
    base = valid_orders_requests(spark, sf_dir).withColumn("base_last", F.element_at("readings", -1))
    out = events.what_if_breakdown(base)
    last = F.element_at("readings", -1)
    return out.select(
        "machine_id", "window_start", last.alias("breakdown_last"), r6("predicted_kwh"),
        F.round(F.aggregate("readings", F.lit(0.0), lambda a, x: a + x), 6).alias("seq_sum"),
        (last > F.col("predicted_kwh") * K.SPIKE_FACTOR).alias("spike_alert"))


@register("request_lookup")
def q_request_lookup(spark, sf_dir):
    out = events.last_window_lookup(fx.readings_from_orders(spark, sf_dir),
                                    registered_machines(spark, sf_dir))
    a = F.col("last_readings")
    return out.select("machine_id", F.size(a).alias("n_values"),
                      F.element_at(a, -1).alias("last_value"),
                      F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 6).alias("seq_sum"))


# --- step 6: forecasting model ----------------------------------------------------------

ROWS_ONLY += ["gbt_predictions", "gbt_table_predictions", "gbt_metrics", "feature_importance"]


def ml_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features for the forecaster: lags and rolling stats, flags, calendar
    (filled when missing), rows with any null feature dropped."""
    return (fx.readings_from_orders(spark, sf_dir).transform(windows.window_features)
            .transform(rules.add_anomaly_flags).transform(prep.fill_missing_columns)
            .transform(prep.drop_incomplete))


def gbt_fit(spark: SparkSession, sf_dir: str):
    train, test = forecast.hash_split(ml_frame(spark, sf_dir), ["machine_id", "reading_id"])
    return forecast.fit_forecaster(train), test


@register("gbt_predictions")
def q_gbt_predictions(spark, sf_dir):
    model, test = gbt_fit(spark, sf_dir)
    return model.transform(test).select("machine_id", "timestamp", "kwh", "is_anomaly", r6("prediction"))


@register("gbt_table_predictions")
def q_gbt_table_predictions(spark, sf_dir):
    """M5 from the saved bundle: the fitted trees as a table of nodes, walked
    down level by level with joins."""
    model, test = gbt_fit(spark, sf_dir)
    path = _scratch(spark, "forecast-bundle")
    bundle.save(spark, path, forecaster=model)
    scaler, nodes = forecast.tree_tables(spark, bundle.part_path(spark, path, "forecast"))
    keys = ["machine_id", "reading_id"]
    return test.join(forecast.predict_by_table(test, scaler, nodes, keys), keys).select(
        "machine_id", "timestamp", "kwh", "is_anomaly", r6("prediction"))


@register("gbt_metrics")
def q_gbt_metrics(spark, sf_dir):
    model, test = gbt_fit(spark, sf_dir)
    return forecast.regression_metrics(model.transform(test))


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    model, _ = gbt_fit(spark, sf_dir)
    return forecast.feature_importance(spark, model)


# --- step 8 (part): prose features -------------------------------------------------------

@register("peak_48h")
def q_peak_48h(spark, sf_dir):
    flagged = flagged_readings(spark, sf_dir).transform(prep.add_calendar)
    fc = rollups.hourly_forecast(flagged)
    now = fx.readings_from_events(spark, sf_dir).groupBy("machine_id").agg(
        F.max("timestamp").alias("ts"))
    return forecast.peak_next_hours(fc, now)


@register("adaptive_threshold")
def q_adaptive_threshold(spark, sf_dir):
    out = insights.adaptive_threshold(fx.readings_from_events(spark, sf_dir))
    return out.select("machine_id", r6("baseline_mean"), r6("baseline_std"), r6("threshold"),
                      "n_after", "n_above")


@register("last_7_days")
def q_last_7_days(spark, sf_dir):
    return insights.recent_window(fx.readings_from_events(spark, sf_dir))


@register("retrain_last_7_days")
def q_retrain_last_7_days(spark, sf_dir):
    """Each machine's bottleneck refitted from the daily moments of its last
    seven days, and the errors of those days' windows under it."""
    r = fx.readings_from_events(spark, sf_dir)
    scaled = sequence.apply_minmax(r, sequence.fit_minmax(r)).drop("kwh").withColumnRenamed("scaled", "kwh")
    wins = windows.trailing_windows(scaled).select("machine_id", F.col("_ord").alias("end_ord"), "timestamp", "readings")
    path = sinks.write_table(insights.daily_moments(wins), _scratch(spark, "daily-moments"), partition_by=["day"])
    models = insights.refit_recent(spark.read.parquet(path))
    scored = sequence.score_per_machine(insights.recent_days(wins), models)
    return scored.join(models.select("machine_id", "n_train"), "machine_id").select(
        "machine_id", "end_ord", "n_train", r6("recon_error"))


@register("lag_correlation")
def q_lag_correlation(spark, sf_dir):
    out = insights.fleet_follow_correlation(fx.readings_from_events(spark, sf_dir))
    return out.select("machine_id", "n_hours", r6("follow_corr"))


# --- step 7: streaming (availableNow over a replay of the tables) --------------------------

def stream_scoring_paths(spark: SparkSession, sf_dir: str) -> dict:
    r = fx.readings_from_orders(spark, sf_dir)
    limits = sequence.thresholds(deviation_scored(spark, sf_dir))
    return feed.run_scoring(spark, r, sequence.fit_minmax(r), limits, sequence.DeviationScorer())


@register("stream_windows")
def q_stream_windows(spark, sf_dir):
    src = feed.replay_folder(spark, fx.readings_from_orders(spark, sf_dir))
    wins = feed.run_append(spark, feed.window_stream(
        feed.read_feed(spark, src, feed.files_per_slice(spark))), "windows")
    return wins.select("machine_id", "end_ord", "window_end_ts", *window_summary(wins))


@register("stream_scores")
def q_stream_scores(spark, sf_dir):
    log = feed.read_table(spark, stream_scoring_paths(spark, sf_dir)["log"], feed.LOG_SCHEMA)
    return log.select("machine_id", "end_ord", "recon_error", "threshold", "is_anomaly",
                      "alert_sent")


@register("stream_metrics")
def q_stream_metrics(spark, sf_dir):
    paths = stream_scoring_paths(spark, sf_dir)
    log = feed.stream_of(spark, paths["log"], feed.LOG_SCHEMA, feed.files_per_slice(spark))
    return feed.run_updates(spark, feed.metrics_stream(log), "metrics", [])


@register("stream_latest")
def q_stream_latest(spark, sf_dir):
    paths = stream_scoring_paths(spark, sf_dir)
    log = feed.stream_of(spark, paths["log"], feed.LOG_SCHEMA, feed.files_per_slice(spark))
    return feed.run_updates(spark, feed.latest_stream(log), "latest", ["machine_id"])


@register("stream_last_n")
def q_stream_last_n(spark, sf_dir):
    log = feed.read_table(spark, stream_scoring_paths(spark, sf_dir)["log"], feed.LOG_SCHEMA)
    return windows.last_n_per_key(log, K.FEED_CAPACITY, tiebreak="end_ord")


@register("stream_snapshot")
def q_stream_snapshot(spark, sf_dir):
    ev = feed.read_table(spark, stream_scoring_paths(spark, sf_dir)["events"], feed.LOG_SCHEMA)
    return events.newest_feed(ev, order=("machine_id", "end_ord"))


@register("stream_dedup")
def q_stream_dedup(spark, sf_dir):
    paths = stream_scoring_paths(spark, sf_dir)

    def doubled():
        relay, socket = (feed.stream_of(spark, paths["events"], feed.LOG_SCHEMA, feed.files_per_slice(spark))
                         for _ in range(2))
        return relay.unionByName(socket)

    out = feed.run_dedup(spark, doubled, "dedup", "30 days", keys=("machine_id", "end_ord"))
    return out.select("machine_id", "end_ord", "timestamp", "recon_error", "threshold")


@register("stream_enrich")
def q_stream_enrich(spark, sf_dir):
    raw = fx.raw_readings_from_orders(spark, sf_dir).withColumnsRenamed({"meter_reading": "kwh"}).select(
        F.col("building_id").alias("machine_id"), "timestamp", "kwh", "reading_id")
    src = feed.replay_folder(spark, raw)
    stream = feed.read_feed(spark, src, feed.files_per_slice(spark)).withColumnRenamed(
        "machine_id", "building_id")
    out = feed.run_append(spark, feed.enrich_stream(stream, fx.metadata_from_customer(spark, sf_dir)),
                          "enrich")
    return out.select(F.col("building_id").alias("machine_id"), "timestamp", "kwh",
                      "reading_id", "site_id", "primary_use")


@register("kpi_stream")
def q_kpi_stream(spark, sf_dir):
    src = feed.replay_folder(spark, fx.readings_from_events(spark, sf_dir))
    return feed.run_complete(
        spark, feed.kpi_stream(feed.read_feed(spark, src, feed.files_per_slice(spark))), "kpis")


@register("json_feed")
def q_json_feed(spark, sf_dir):
    """A JSON feed with broken lines (every 97th is cut short): accepted
    readings, and the rejected records with the id that is left in them."""
    path = _scratch(spark, "json-feed")
    line = F.to_json(F.struct("reading_id", "machine_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "kwh"))
    fx.readings_from_events(spark, sf_dir).select(
        F.when(F.col("reading_id") % 97 == 0, F.left(line, F.length(line) - 9)).otherwise(line).alias("value")).write.text(path)
    accepted, rejected = feed.run_quarantine(spark, path, "json-quarantine")
    left = rejected.select(F.regexp_extract("record", r'"reading_id":(\d+)', 1).cast("long").alias("reading_id"))
    return accepted.withColumn("accepted", F.lit(True)).unionByName(left.withColumn("accepted", F.lit(False)), allowMissingColumns=True)


# --- step 8: sinks and sources round trips --------------------------------------------------

KPI_SCHEMA = ("machine_id bigint, total_readings bigint, avg_kwh double, peak_kwh double, "
              "min_kwh double, std_kwh double, p95_kwh double, total_anomalies bigint, "
              "anomaly_rate_pct double")
PRED_LOG_SCHEMA = ("timestamp timestamp_ntz, machine_id bigint, actual_kwh double, "
                   "predicted_kwh double, recon_error double, threshold double, "
                   "is_anomaly int, alert_sent int, latency_ms double")


def _scratch(spark: SparkSession, name: str) -> str:
    return feed.new_run_dir(spark, name)


@register("csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    path = sinks.save_result_csv(q_machine_kpis(spark, sf_dir), _scratch(spark, "kpis-csv"))
    return files.read_result_dir(spark, path, KPI_SCHEMA)


@register("log_append")
def q_log_append(spark, sf_dir):
    log = scored_log(spark, sf_dir)
    path = _scratch(spark, "log-append")
    first = F.col("alert_sent").eqNullSafe(1)      # null-safe: every row lands once
    sinks.append_log(log.filter(first), path)
    sinks.append_log(log.filter(~first), path)
    return files.read_log(spark, path, PRED_LOG_SCHEMA, fmt="parquet")


@register("processed_csv_ingest")
def q_processed_csv_ingest(spark, sf_dir):
    # a CSV with reordered and missing columns, read by header name
    path = _scratch(spark, "processed-csv")
    (fx.readings_from_events(spark, sf_dir).select("kwh", "timestamp", "machine_id")
     .write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
     .csv(path))
    df = files.ingest_processed(spark, path)
    return df.select("machine_id", "timestamp", "kwh", "air_temperature", "hour", "month",
                     "dayofweek", "is_weekend")


@register("csv_rejects")
def q_csv_rejects(spark, sf_dir):
    """S3: a CSV with malformed readings, times that do not parse and negative
    readings: what was read and what was rejected, and why."""
    path = _scratch(spark, "csv-rejects")
    n = F.col("reading_id")
    (fx.readings_from_events(spark, sf_dir).select(
        "machine_id", F.when(n % 103 == 0, F.lit("yesterday")).otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.when(n % 101 == 0, F.lit("n/a")).when(n % 107 == 0, F.lit("-1")).otherwise(F.col("kwh").cast("string")).alias("kwh"),
        n.cast("string").alias("tag")).write.option("header", True).csv(path))
    good, rejects = files.ingest_with_rejects(spark, path)
    left = rejects.select("reason", F.regexp_extract("record", r'(\d+)"?}?$', 1).alias("tag"))
    out = good.select("tag", "machine_id", "kwh", F.lit("read").alias("reason")).unionByName(left, allowMissingColumns=True)
    return out.select(F.col("tag").cast("long").alias("reading_id"), "machine_id", "kwh", "reason")


@register("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    scored, scorer = pca_scored(spark, sf_dir)
    path = sinks.save_model(scorer.to_frame(spark), _scratch(spark, "model"))
    loaded = sequence.PcaScorer.from_frame(spark.read.parquet(path))
    w = sequence.scaled_windows(fx.readings_from_orders(spark, sf_dir))
    return sequence.score(w, loaded).select("machine_id", "window_start", r6("recon_error"))


# --- remaining presentation operators ---------------------------------------------------------

@register("scoring_response")
def q_scoring_response(spark, sf_dir):
    return events.scoring_response(scored_requests(spark, sf_dir))


@register("global_threshold_flags")
def q_global_threshold_flags(spark, sf_dir):
    """One fleet-wide threshold (a one-row table) attached to every window."""
    scored = deviation_scored(spark, sf_dir)
    params = sequence.thresholds(scored, by=None).select(
        F.col("threshold").alias("fleet_threshold"))
    out = prep.attach_params(scored, params)
    return out.select("machine_id", "window_start", r6("recon_error"), r6("fleet_threshold"),
                      (F.col("recon_error") > F.col("fleet_threshold")).cast("int").alias("is_anomaly"))


@register("anomaly_sample")
def q_anomaly_sample(spark, sf_dir):
    flagged = flagged_readings(spark, sf_dir).filter(F.col("is_anomaly") == 1)
    return events.sample_rows(flagged, 10, ["machine_id", "timestamp", "reading_id"]).select(
        "machine_id", "timestamp", "kwh", r6("rolling_avg_24h"), r6("z_score"),
        "spike_flag", "drop_flag", "zscore_flag")


@register("log_summary")
def q_log_summary(spark, sf_dir):
    """Scored and flagged rows of the edge log."""
    return rollups.log_summary(q_baseline_edge_log(spark, sf_dir))


@register("sorted_readings")
def q_sorted_readings(spark, sf_dir):
    """O1: readings clustered by machine and sorted by time within it."""
    return prep.sort_readings(fx.readings_from_events(spark, sf_dir))


# --- per-machine bottleneck models (M9) ------------------------------------------------------



def machine_model_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = sequence.scaled_windows(fx.readings_from_orders(spark, sf_dir))
    models = sequence.fit_machine_pca(w.filter(F.col("split") == "train"))
    return sequence.score_per_machine(w, models)


@register("machine_model_scores")
def q_machine_model_scores(spark, sf_dir):
    return machine_model_scored(spark, sf_dir).select(
        "machine_id", "window_start", "split", r6("recon_error"))


@register("machine_model_threshold")
def q_machine_model_threshold(spark, sf_dir):
    t = sequence.thresholds(machine_model_scored(spark, sf_dir))
    return t.select("machine_id", r6("error_mean"), r6("error_std"), "n_errors", r6("threshold"))


# --- file sources and sinks over derived files (S1, S2, S4, S5, S12) ----------------------

def _raw_csv(spark: SparkSession, sf_dir: str) -> str:
    path = _scratch(spark, "raw-csv")
    fx.raw_readings_from_orders(spark, sf_dir).select(
        F.col("building_id").cast("int"), "meter",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "meter_reading").write.option("header", True).csv(path)
    return path


@register("raw_csv_scan")
def q_raw_csv_scan(spark, sf_dir):
    """S1 + S2 + P1/P2: a raw readings CSV filtered to one meter and the
    machines of a metadata CSV (semi join)."""
    meta_path = _scratch(spark, "meta-csv")
    fx.metadata_from_customer(spark, sf_dir).select(
        "site_id", F.col("building_id").cast("int"), "primary_use").write.option(
        "header", True).csv(meta_path)
    meta = files.read_dimension(spark, meta_path, "site_id int, building_id int, primary_use string")
    machines = meta.filter(F.col("primary_use") == TARGET_SEGMENT).select("building_id")
    return files.read_raw_readings(spark, _raw_csv(spark, sf_dir), meter=0, machines=machines)


@register("fallback_ingest")
def q_fallback_ingest(spark, sf_dir):
    """The primary input is absent, so the fallback file is read (by
    header name)."""
    fallback = _scratch(spark, "fallback-csv")
    (fx.readings_from_events(spark, sf_dir).select("timestamp", "machine_id", "kwh")
     .write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
     .csv(fallback))
    df = files.ingest_processed(spark, _scratch(spark, "absent-primary"), fallback=fallback)
    return df.select("machine_id", "timestamp", "kwh", "hour", "is_weekend")


@register("partitioned_table")
def q_partitioned_table(spark, sf_dir):
    """Readings written partitioned by month and read back whole (a month
    filter reads only its folder, see the tests)."""
    path = _scratch(spark, "by-month")
    r = fx.readings_from_orders(spark, sf_dir).withColumn("month", F.month("timestamp"))
    sinks.write_table(r, path, partition_by=["month"])
    return spark.read.parquet(path).select(
        "machine_id", "timestamp", "kwh", "reading_id", F.col("month").cast("int").alias("month"))


@register("alert_records")
def q_alert_records(spark, sf_dir):
    """Fired alerts appended to an alert table and read back."""
    path = _scratch(spark, "alerts")
    sinks.write_alerts(events.alert_document(scored_requests(spark, sf_dir)), path)
    return spark.read.parquet(path)


#: Time slot of the registered slot-window queries: some fifty readings of a
#: machine at the smallest scale, and a bounded group at any.
READING_SLOT = "365 days"


@register("stream_windows_batched")
def q_stream_windows_batched(spark, sf_dir):
    """T1 with state per machine and time slot, merged at the seams, so that a
    hot machine's readings go through many tasks (same result as
    ``stream_windows``)."""
    src = feed.replay_folder(spark, fx.readings_from_orders(spark, sf_dir))
    stream = feed.read_feed(spark, src, feed.files_per_slice(spark))
    wins = slots.run_windows(spark, stream, feed.new_run_dir(spark, "slot-windows"), slot=READING_SLOT)
    return wins.select("machine_id", "end_ord", "window_end_ts", *window_summary(wins))


@register("stream_scores_batched")
def q_stream_scores_batched(spark, sf_dir):
    """T1-T4 on slot windows (same result as ``stream_scores``)."""
    r = fx.readings_from_orders(spark, sf_dir)
    limits = sequence.thresholds(deviation_scored(spark, sf_dir))
    paths = slots.run_scoring(spark, r, sequence.fit_minmax(r), limits, sequence.DeviationScorer(), slot=READING_SLOT)
    log = slots.numbered(feed.read_table(spark, paths["log"], slots.LOG_SCHEMA))
    return log.select("machine_id", "end_ord", "recon_error", "threshold", "is_anomaly",
                      "alert_sent")
