"""Property checks (hypothesis) of the window features and rules against a
pandas computation, on random series with ties and several machines."""

import datetime as dt

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from meterflow.operators import rules, windows

series = st.lists(
    st.tuples(st.integers(0, 2),                    # machine
              st.integers(0, 40),                   # hour (ties allowed)
              st.floats(0, 500, allow_nan=False)),  # kwh
    min_size=1, max_size=80)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=series, chunk=st.sampled_from([3, 10, 10**6]))
def test_features_and_flags_match_pandas(spark, rows, chunk):
    t0 = dt.datetime(2024, 1, 1)
    data = [(m, t0 + dt.timedelta(hours=h), round(v, 2), i) for i, (m, h, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "machine_id bigint, timestamp timestamp_ntz, kwh double, "
                                     "reading_id bigint")
    got = (windows.window_features(df, chunk_rows=chunk).transform(rules.add_anomaly_flags)
           .toPandas().set_index("reading_id").sort_index())

    pdf = df.toPandas().sort_values(["machine_id", "timestamp", "reading_id"])
    g = pdf.groupby("machine_id")["kwh"]
    prev = lambda f: g.transform(lambda s: f(s.shift(1).rolling(24, min_periods=1)))
    pdf["avg"] = prev(lambda r: r.mean())
    pdf["std"] = prev(lambda r: r.std())
    pdf["lag24"] = g.shift(24)
    want = pdf.set_index("reading_id").sort_index()

    assert np.allclose(got["rolling_avg_24h"], want["avg"], equal_nan=True)
    assert np.allclose(got["rolling_std_24h"], want["std"], equal_nan=True, atol=1e-9)
    assert np.allclose(got["lag_24h"], want["lag24"], equal_nan=True)
    spike = (want["kwh"] > want["avg"] * 1.5).astype(int)
    assert (got["spike_flag"].to_numpy() == spike.to_numpy()).all()
    assert (got["is_anomaly"] == got[["spike_flag", "drop_flag", "zscore_flag"]].max(axis=1)).all()
