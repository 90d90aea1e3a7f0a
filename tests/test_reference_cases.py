"""Cases taken from the reference's tests, logs and documented examples, plus
edge cases of the rules and windows (hand-made rows)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterflow import constants as K
from meterflow.operators import events, rollups, rules, sequence, windows

VALID = [80, 82, 85, 81, 80, 83, 90, 102, 118, 125, 130, 128,
         122, 119, 115, 112, 118, 125, 132, 128, 115, 105, 98, 90]
REQ_SCHEMA = "machine_id bigint, readings array<double>, predicted_kwh double"


def _requests(spark, rows):
    return spark.createDataFrame(rows, REQ_SCHEMA)


def test_request_validation(spark):
    rows = [(0, [float(x) for x in VALID], None),
            (0, [100.0] * 10, None),
            (0, [-5.0] + [float(x) for x in VALID[1:]], None),
            (-1, [float(x) for x in VALID], None),
            (1, [float(x) for x in VALID], -2.0)]
    out = events.validate_requests(_requests(spark, rows)).collect()
    assert [r.is_valid for r in out] == [True, False, False, False, False]
    assert out[1].rejection == "Expected exactly 24 readings, got 10"
    assert out[2].rejection == "kWh readings cannot be negative"


def _decide(spark, rows):
    df = spark.createDataFrame(
        rows, "machine_id bigint, readings array<double>, predicted_kwh double, "
              "recon_error double, threshold double")
    return {r.machine_id: r for r in events.decide_alerts(df).collect()}


def test_alert_cases(spark):
    base = [float(x) for x in VALID]
    spike = base[:-1] + [380.0]
    out = _decide(spark, [
        (0, base, None, 0.01, 0.05),      # normal
        (2, base, 95.0, 0.99, 0.05),      # anomalous
        (1, base, 88.5, 0.01, 0.05),      # with forecast, below spike factor
        (3, spike, 90.0, 0.01, 0.05),     # documented spike example
    ])
    assert not out[0].is_anomaly and not out[0].alert_fired
    assert out[0].alert_reason == K.NO_ALERT_REASON
    assert out[0].predicted_kwh == 90.0            # forecast defaults to the last reading
    assert out[2].is_anomaly and out[2].alert_fired
    assert out[2].alert_reason == "recon_error (0.9900) > threshold (0.0500)"
    assert not out[1].alert_fired
    assert out[3].alert_fired and not out[3].is_anomaly
    assert out[3].alert_reason == "actual (380.0 kWh) > 1.5× predicted (90.0)"


def test_alert_document_fields(spark):
    df = spark.createDataFrame(
        [(2, 0.99, 0.05, 90.0, 95.0, "r", dt.datetime(2024, 1, 1, 10, 0))],
        "machine_id bigint, recon_error double, threshold double, actual_kwh double, "
        "predicted_kwh double, alert_reason string, request_ts timestamp_ntz")
    import json
    doc = json.loads(events.alert_document(df).first().payload)["attachments"][0]
    assert doc["title"] == "🚨 Energy Anomaly — Machine 2"
    values = {f["title"]: f["value"] for f in doc["fields"]}
    assert values["Actual kWh"] == "90.00" and values["Threshold"] == "0.050000"
    assert values["Spike Factor"] == "1.5×" and values["Timestamp"] == "2024-01-01 10:00 UTC"


LOG_ROWS = [
    ("2024-01-01T10:00:00", 0, 200.0, 90.0, 0.99, 0.05, 1, 0, 3.2),
    ("2024-01-01T11:00:00", 1, 85.0, 90.0, 0.01, 0.05, 0, 0, 2.1),
    ("2024-01-01T12:00:00", 0, 210.0, 90.0, 0.95, 0.05, 1, 1, 3.8),
]
LOG_SCHEMA = ("timestamp string, machine_id bigint, actual_kwh double, predicted_kwh double, "
              "recon_error double, threshold double, is_anomaly int, alert_sent int, "
              "latency_ms double")


def test_log_readback_filter_and_metrics(spark):
    log = spark.createDataFrame(LOG_ROWS, LOG_SCHEMA)
    assert events.recent_anomalies(log, machine_id=0).count() == 2
    flags = [int(r.recon_error > r.threshold) for r in log.collect()]
    assert flags == [1, 0, 1]
    m = rollups.scoring_metrics(log).first()
    assert (m.total_requests, m.total_anomalies, m.total_alerts) == (3, 2, 1)
    assert m.anomaly_rate_pct == 66.67 and m.avg_latency_ms == 3.03
    empty = rollups.scoring_metrics(log.limit(0)).first()
    assert empty.total_requests == 0 and empty.anomaly_rate_pct == 0.0
    with pytest.raises(ValueError):
        events.recent_anomalies(log, last_n=501)


def _series(spark, values, machine=0, start=dt.datetime(2024, 1, 1)):
    rows = [(machine, start + dt.timedelta(hours=i), v, i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "machine_id bigint, timestamp timestamp_ntz, "
                                       "kwh double, reading_id bigint")


def test_rule_edge_cases(spark):
    vals = [10.0, 10.0, 10.0, 0.0, 0.0, 100.0]
    out = _series(spark, vals).transform(windows.window_features).transform(
        rules.add_anomaly_flags).orderBy("reading_id").collect()
    assert out[0].rolling_avg_24h is None and out[0].rolling_std_24h is None
    assert out[1].rolling_std_24h is None and out[1].z_score == 0.0
    assert out[3].rolling_std_24h == 0.0 and out[3].z_score == 0.0     # std = 0
    assert out[3].drop_flag == 1                                        # 0 < 0.2 * 10
    assert out[5].spike_flag == 1
    for r in out:
        assert r.is_anomaly == max(r.spike_flag, r.drop_flag, r.zscore_flag)


def test_rolling_frame_excludes_current_row(spark):
    vals = [float(i) for i in range(40)]
    out = _series(spark, vals).transform(windows.window_features).orderBy("reading_id").collect()
    for i, r in enumerate(out[1:], start=1):
        prev = vals[max(0, i - 24):i]
        assert r.rolling_avg_24h == pytest.approx(np.mean(prev))
        assert r.rolling_max_24h == max(prev) and r.rolling_min_24h == min(prev)
        assert r.lag_1h == vals[i - 1]
        assert r.lag_24h == (vals[i - 24] if i >= 24 else None)


@pytest.mark.parametrize("n", [1, 2, 23, 24, 25, 30])
def test_window_count(spark, n):
    w = windows.sequence_windows(_series(spark, [float(i) for i in range(n)]))
    assert w.count() == max(0, n - 24)
    if n > 24:
        first = w.orderBy("window_start").first()
        assert first.readings == [float(i) for i in range(24)]


def test_machines_never_mix(spark):
    a = _series(spark, [1.0] * 30, machine=1)
    b = _series(spark, [2.0] * 30, machine=2, start=dt.datetime(2024, 1, 1, 0, 30))
    w = windows.sequence_windows(a.unionByName(b))
    for r in w.collect():
        assert set(r.readings) == {float(r.machine_id)}


def test_edge_log_index_range(spark):
    # 8784 hourly readings (one leap year) give hour_index 7051..7250
    df = spark.range(8784).select(
        F.lit(0).cast("bigint").alias("machine_id"),
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("timestamp"),
        (F.col("id") % 24).cast("double").alias("kwh"), F.col("id").alias("reading_id"))
    tail = windows.edge_windows(df, steps=200).agg(F.count("*"), F.min("hour_index"), F.max("hour_index"))
    assert tuple(tail.first()) == (200, 7051, 7250)


def test_minmax_constant_series(spark):
    df = _series(spark, [5.0] * 30)
    out = sequence.apply_minmax(df, sequence.fit_minmax(df)).select("scaled").distinct().collect()
    assert [r.scaled for r in out] == [0.0]


def test_threshold_is_population_std(spark):
    errs = [0.1, 0.2, 0.4, 0.3]
    df = spark.createDataFrame([(e, "validation") for e in errs], "recon_error double, split string")
    t = sequence.thresholds(df, by=None).first()
    assert t.threshold == pytest.approx(np.mean(errs) + 3 * np.std(errs))


def test_pca_scorer_matches_numpy(spark):
    rng = np.random.default_rng(7)
    X = rng.random((300, 24))
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)],
                               "window_start bigint, readings array<double>")
    scorer = sequence.fit_pca_scorer(df)
    got = np.array([r.recon_error for r in
                    sequence.score(df, scorer).orderBy("window_start").collect()])
    mu = X.mean(axis=0)
    cov = np.cov(X - mu, rowvar=False)
    vals, vecs = np.linalg.eigh(cov)
    P = vecs[:, np.argsort(vals)[::-1][:K.LATENT_DIM]]
    R = mu + (X - mu) @ P @ P.T
    want = np.abs(R - X).mean(axis=1)
    assert np.allclose(got, want, atol=1e-8)
    again = sequence.PcaScorer.from_frame(scorer.to_frame(spark))
    assert np.allclose(again.projection, scorer.projection)


def test_latest_state_and_idle(spark):
    log = spark.createDataFrame(LOG_ROWS, LOG_SCHEMA)
    machines = spark.createDataFrame([(0,), (1,), (7,)], "machine_id bigint")
    st = {r.machine_id: r for r in events.latest_state(log, machines).collect()}
    assert st[0].kwh == 210.0 and st[0].status == K.STATUS_ANOMALY
    assert st[1].status == K.STATUS_NORMAL and st[7].status == K.STATUS_IDLE


def test_per_machine_pca_matches_numpy(spark):
    rng = np.random.default_rng(11)
    data = {m: rng.random((60 + 20 * m, 24)) * (m + 1) for m in range(3)}
    rows = [(m, i, [float(v) for v in x]) for m, X in data.items() for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "machine_id bigint, window_start bigint, readings array<double>")
    models = sequence.fit_machine_pca(df)
    for limit in (10**9, 0):                       # broadcast lookup, then join path
        got = {(r.machine_id, r.window_start): r.recon_error for r in
               sequence.score_per_machine(df, models, broadcast_limit=limit).collect()}
        for m, X in data.items():
            mu = X.mean(axis=0)
            vals, vecs = np.linalg.eigh(np.cov(X - mu, rowvar=False))
            P = vecs[:, np.argsort(vals)[::-1][:K.LATENT_DIM]]
            want = np.abs(mu + (X - mu) @ P @ P.T - X).mean(axis=1)
            assert np.allclose([got[(m, i)] for i in range(len(X))], want, atol=1e-6)


def test_zero_mean_rules(spark):
    # mean 0: the drop rule needs mean > 0; any positive reading is a spike
    out = _series(spark, [0.0, 0.0, 0.0, 5.0]).transform(windows.window_features).transform(
        rules.add_anomaly_flags).orderBy("reading_id").collect()
    assert [r.drop_flag for r in out] == [0, 0, 0, 0]
    assert [r.spike_flag for r in out] == [0, 0, 0, 1]


def test_feed_filter_by_label(spark):
    log = spark.createDataFrame(LOG_ROWS, LOG_SCHEMA)
    assert events.filter_by_label(log, "ALL").count() == 3
    assert events.filter_by_label(log, "M-0").count() == 2
    assert events.filter_by_label(log, "M-7").count() == 0


def test_scaler_fit_on_train_only(spark):
    # the last readings (validation) are far larger than the training ones
    vals = [float(i % 10) for i in range(90)] + [100.0] * 10   # training reaches position 82
    df = _series(spark, vals)
    everything = sequence.fit_scaler(df).first()
    train_only = sequence.fit_scaler(df, fit_on="train").first()
    assert everything.scale_max == 100.0 and train_only.scale_max == 9.0
    w = sequence.scaled_windows(df, scaler_fit="train")
    top = w.filter("split = 'validation'").selectExpr("max(array_max(readings)) m").first().m
    assert top > 1.0          # unseen levels scale above 1, as with a train-only scaler
