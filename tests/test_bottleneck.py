"""The bottleneck scorer as a product of tables, and its degenerate models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterflow.operators import sequence


def _windows(spark, machines=3, per=60, width=24, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((machines, 10, width))
    rows = [(m, i, [float(x) for x in rng.standard_normal(10) @ base[m] + 0.1 * rng.standard_normal(width)])
            for m in range(machines) for i in range(per)]
    return spark.createDataFrame(rows, "machine_id bigint, window_start bigint, readings array<double>")


def _errors(df):
    return {(r.machine_id, r.window_start): r.recon_error for r in df.collect()}


def test_product_of_tables_equals_the_vectorised_scorer(spark):
    w = _windows(spark)
    scorer = sequence.fit_pca_scorer(w)
    plain = _errors(sequence.score(w, scorer))
    long = _errors(sequence.score_long(w, *sequence.model_long(spark, scorer)))
    assert len(long) == 180 and long.keys() == plain.keys()
    assert all(long[k] == pytest.approx(plain[k], abs=1e-12) for k in plain)


def test_per_machine_product_equals_the_lookup(spark):
    w = _windows(spark)
    models = sequence.fit_machine_pca(w)
    plain = _errors(sequence.score_per_machine(w, models))
    joined = _errors(sequence.score_per_machine(w, models, broadcast_limit=0))
    long = _errors(sequence.score_long(w, *sequence.models_long(models), by="machine_id"))
    for k in plain:
        assert long[k] == pytest.approx(plain[k], abs=1e-12) and joined[k] == pytest.approx(plain[k], abs=1e-12)


def test_windows_without_an_error(spark):
    w = _windows(spark, machines=2, per=40)
    models = sequence.fit_machine_pca(w.where("machine_id = 0"))
    odd = spark.createDataFrame([(0, 900, None), (0, 901, [1.0, 2.0]), (None, 902, [1.0] * 24), (0, None, [1.0] * 24)], w.schema)
    got = _errors(sequence.score_long(w.unionByName(odd), *sequence.models_long(models), by="machine_id"))
    assert len(got) == 84
    for key, error in got.items():
        assert (error is None) == (key[0] != 0 or key[1] in (900, 901)), key


def test_directions_without_variance_carry_nothing(spark):
    """Four windows span three directions at most: the rest of the eight is left out."""
    w = _windows(spark, machines=1, per=4)
    model = sequence.fit_machine_pca(w).first()
    p = np.array(model["projection"]).reshape(24, 24)
    assert np.trace(p) == pytest.approx(3)
    one = sequence.fit_machine_pca(w.where("window_start = 0")).first()
    assert not np.any(one["projection"])
    again = sequence.score_per_machine(w.where("window_start = 0"), sequence.fit_machine_pca(w.where("window_start = 0")))
    assert again.select(F.abs("recon_error") < 1e-12).first()[0]


def test_the_product_stays_in_the_windows_rows(spark):
    """No entry of a window is exploded, shuffled or joined back: windows that share their keys keep their own errors."""
    w = _windows(spark, machines=2, per=40)
    scorer = sequence.fit_pca_scorer(w)
    scored = sequence.score_long(w.withColumn("window_start", F.lit(0).cast("long")), *sequence.model_long(spark, scorer))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert not any("window_start" in line and ("Exchange" in line or "Generate" in line) for line in plan.splitlines())
    want = sorted(r.recon_error for r in sequence.score(w, scorer).collect())
    assert sorted(r.recon_error for r in scored.collect()) == pytest.approx(want, abs=1e-12)
