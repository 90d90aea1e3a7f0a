"""Every registered query with oracle SQL equals DuckDB on the driver tables.

Runs at sf0.001 (the driver repeats this at sf0.01); window queries run a
second time with tiny chunks so the hot-machine path is compared too."""

import pytest

from meterflow.plans import catalog, oracle, verify
from tests.conftest import SF_SMALL

ORACLE_NAMES = sorted(n for n in catalog.REGISTRY if n in oracle.ORACLE)
CHUNKED = ["window_features", "sequence_windows", "edge_windows", "last_n_per_machine",
           "baseline_edge_log", "request_lookup", "validate_requests", "stream_windows_batched"]


@pytest.mark.parametrize("name", ORACLE_NAMES)
def test_matches_duckdb(spark, duck_small, name):
    r = verify.compare(spark, name, SF_SMALL, duck_small)
    assert r["columns_match"], r
    assert not r["type_differences"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["ok"], r


@pytest.mark.parametrize("name", CHUNKED)
def test_chunked_path_matches_duckdb(spark, duck_small, name):
    spark.conf.set("meterflow.chunkRows", "7")
    try:
        r = verify.compare(spark, name, SF_SMALL, duck_small)
    finally:
        spark.conf.unset("meterflow.chunkRows")
    assert r["ok"], r


def test_every_query_has_oracle_or_is_listed():
    rows_only = set(catalog.REGISTRY) - set(oracle.ORACLE)
    assert rows_only <= set(catalog.ROWS_ONLY), rows_only
