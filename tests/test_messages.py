"""Relay messages: which events each gives, and the aliases they are filled from."""

import json

from meterflow.operators import events


def _events(spark, *messages):
    df = spark.createDataFrame([(json.dumps(m),) for m in messages], "message string")
    return [tuple(r)[:5] + (r.from_alarm,) for r in events.normalise_messages(df).collect()]


def test_an_alarm_with_readings_gives_two_events(spark):
    alarm = {"type": "ANOMALY_ALARM", "machine_id": 3, "readings": [1.0, 7.5], "error": 0.4, "recon_error": 0.2}
    assert _events(spark, alarm) == [(3, 7.5, 0.2, 0.0979, True, False), (3, 0.0, 0.4, 0.0979, True, True)]


def test_an_alarm_without_readings_or_machine_gives_one(spark):
    assert _events(spark, {"type": "ANOMALY_ALARM", "machine_id": 3, "kwh": 2.0, "recon_error": 0.2, "threshold": 0.1}) == [
        (3, 2.0, 0.2, 0.1, True, True)]
    assert _events(spark, {"type": "ANOMALY_ALARM", "readings": [1.0]}) == [(None, 0.0, 0.0, 0.0979, True, True)]


def test_a_data_point_gives_one(spark):
    point = {"machine_id": 1, "kwh": 0, "readings": [4.0], "error": 0.3, "is_anomaly": False}
    assert _events(spark, point, {"machine_id": 2, "kwh": 5.0, "recon_error": 0.1, "is_anomaly": True}) == [
        (1, 4.0, 0.3, 0.0979, False, False), (2, 5.0, 0.1, 0.0979, True, False)]
