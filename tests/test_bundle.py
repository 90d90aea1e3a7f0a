"""The model bundle, and the fitted trees as tables."""

import pytest
from pyspark.sql import functions as F

from meterflow import bundle
from meterflow.operators import forecast, sequence
from meterflow.plans import catalog
from meterflow.streaming import feed
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def fitted(spark):
    model, test = catalog.gbt_fit(spark, SF_SMALL)
    path = feed.new_run_dir(spark, "test-bundle")
    bundle.save(spark, path, forecaster=model)
    return model, test.cache(), path


def test_tree_table_equals_the_fitted_model(spark, fitted):
    model, test, path = fitted
    scaler, nodes = forecast.tree_tables(spark, bundle.part_path(spark, path, "forecast"))
    assert nodes.select("tree").distinct().count() == 30 and scaler.count() == 8
    keys = ["machine_id", "reading_id"]
    got = {(r.machine_id, r.reading_id): r.prediction for r in
           forecast.predict_by_table(test, scaler, nodes, keys).collect()}
    want = {(r.machine_id, r.reading_id): r.prediction for r in model.transform(test).select(*keys, "prediction").collect()}
    assert got.keys() == want.keys() and len(got) > 30
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_tree_table_metrics_and_importance(spark, fitted):
    model, test, path = fitted
    scaler, nodes = forecast.tree_tables(spark, bundle.part_path(spark, path, "forecast"))
    keys = ["machine_id", "reading_id"]
    by_table = forecast.regression_metrics(test.join(forecast.predict_by_table(test, scaler, nodes, keys), keys)).first()
    by_model = forecast.regression_metrics(model.transform(test)).first()
    assert tuple(by_table) == pytest.approx(tuple(by_model), rel=1e-9)
    want = {r.feature: r.importance for r in forecast.feature_importance(spark, model).collect()}
    got = forecast.importance_by_table(scaler, nodes).collect()
    assert {r.feature: r.importance for r in got} == pytest.approx(want, abs=1e-9)
    assert [r.importance for r in got] == sorted((r.importance for r in got), reverse=True)


def test_rows_with_a_missing_feature_are_skipped(spark, fitted):
    model, test, path = fitted
    scaler, nodes = forecast.tree_tables(spark, bundle.part_path(spark, path, "forecast"))
    odd = test.limit(3).withColumn("lag_1h", F.when(F.col("reading_id") == test.first()["reading_id"], None).otherwise(float("nan")))
    assert forecast.predict_by_table(odd, scaler, nodes, ["machine_id", "reading_id"]).count() == 0
    assert model.transform(odd.withColumn("lag_1h", F.lit(None).cast("double"))).count() == 0


def _scorer(k):
    mean = [0.5] * 24
    return sequence.PcaScorer(mean, [[1.0 if i == j < k else 0.0 for j in range(24)] for i in range(24)], k)


def test_bundle_round_trip_and_versions(spark):
    path = feed.new_run_dir(spark, "test-bundle-parts")
    with pytest.raises(FileNotFoundError):
        bundle.load(spark, path)
    bounds = spark.createDataFrame([(1, 0.0, 2.0), (2, 1.0, 1.0)], "machine_id bigint, scale_min double, scale_max double")
    limits = spark.createDataFrame([(1, 0.3)], "machine_id bigint, threshold double")
    first = bundle.save(spark, path, bounds=bounds, thresholds=limits, scorer=_scorer(8))
    loaded = bundle.load(spark, path)
    assert loaded.version == first and loaded.models is None and loaded.forecaster is None
    assert sorted(map(tuple, loaded.bounds.collect())) == sorted(map(tuple, bounds.collect()))
    assert loaded.scorer.projection == _scorer(8).projection and loaded.scorer.k == 8

    second = bundle.save(spark, path, bounds=loaded.bounds, thresholds=limits, scorer=_scorer(3))
    assert second != first and bundle.load(spark, path).scorer.k == 3
    assert loaded.bounds.count() == 2                # the version in use is still there
    with pytest.raises(ValueError):
        bundle.part_path(spark, path, "weights")


def test_a_damaged_part_is_noticed(spark):
    path = feed.new_run_dir(spark, "test-bundle-damage")
    limits = spark.createDataFrame([(1, 0.3), (2, 0.4)], "machine_id bigint, threshold double")
    bundle.save(spark, path, thresholds=limits)
    limits.limit(1).write.mode("overwrite").parquet(bundle.part_path(spark, path, "thresholds"))
    with pytest.raises(ValueError, match="manifest"):
        bundle.load(spark, path)


def test_scoring_needs_a_bottleneck(spark):
    with pytest.raises(ValueError, match="bottleneck"):
        bundle.Bundle("x", "1").score(spark.range(1))
