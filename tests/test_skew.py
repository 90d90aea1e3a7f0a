"""A machine holding a third of all readings is split across tasks, and the
window results still equal a straightforward per-machine computation."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from meterflow.operators import ordered, windows


def _skewed(spark, hot_rows=3000, others=60, per_other=100):
    rng = np.random.default_rng(3)
    rows = []
    t0 = dt.datetime(2024, 1, 1)
    # machine 0: a third of all rows, irregular gaps and some tied times
    gaps = np.cumsum(rng.integers(0, 4, hot_rows))
    for i in range(hot_rows):
        rows.append((0, t0 + dt.timedelta(minutes=int(gaps[i])), float(rng.random() * 100), i))
    rid = hot_rows
    for m in range(1, others + 1):
        for i in range(per_other):
            rows.append((m, t0 + dt.timedelta(hours=i), float(rng.random() * 100), rid))
            rid += 1
    return spark.createDataFrame(rows, "machine_id bigint, timestamp timestamp_ntz, "
                                       "kwh double, reading_id bigint")


def test_hot_machine_is_split_and_exact(spark):
    df = _skewed(spark)
    chunk_rows = 500
    sizes = (ordered.chunk_plan(df, "machine_id", ["timestamp", "reading_id"], chunk_rows)
             .groupBy("machine_id", "_chunk").count())
    hot = sizes.filter("machine_id = 0")
    assert hot.count() > 1                               # the hot machine is cut up
    assert hot.agg(F.max("count")).first()[0] <= chunk_rows

    got = windows.window_features(df, chunk_rows=chunk_rows, keep_position=True).toPandas()
    pdf = df.toPandas().sort_values(["machine_id", "timestamp", "reading_id"])
    g = pdf.groupby("machine_id")["kwh"]
    want = pdf.assign(
        _ord=pdf.groupby("machine_id").cumcount(),
        lag_1h=g.shift(1), lag_24h=g.shift(24),
        rolling_avg_24h=g.transform(lambda s: s.shift(1).rolling(24, min_periods=1).mean()),
        rolling_max_24h=g.transform(lambda s: s.shift(1).rolling(24, min_periods=1).max()))
    merged = got.merge(want, on="reading_id", suffixes=("", "_want"))
    assert len(merged) == len(pdf)
    for c in ["_ord", "lag_1h", "lag_24h", "rolling_avg_24h", "rolling_max_24h"]:
        a, b = merged[c].to_numpy(dtype=float), merged[f"{c}_want"].to_numpy(dtype=float)
        assert np.allclose(a, b, equal_nan=True), c


def _burst(spark, spread):
    """200,000 rows of one machine, all but ten of them in one second (spread
    over its microseconds, or all at the same instant), and a second hot machine."""
    base = F.lit(dt.datetime(2024, 3, 1, 12)).cast("timestamp_ntz")
    i = F.col("id")
    inside = F.timestamp_add("MICROSECOND", (i % 1_000_000).cast("int") * spread, base)
    burst = spark.range(200_000).select(
        F.lit(1).cast("long").alias("machine_id"),
        F.when(i < 10, F.timestamp_add("DAY", (i * 30).cast("int"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")))
        .otherwise(inside).alias("timestamp"), ((i * 37) % 101).cast("double").alias("kwh"), i.alias("reading_id"))
    even = spark.range(40_000).select(
        F.lit(2).cast("long").alias("machine_id"), F.timestamp_add("MINUTE", i.cast("int"), base).alias("timestamp"),
        (i % 7).cast("double").alias("kwh"), (i + 1_000_000).alias("reading_id"))
    return burst.unionByName(even)


def test_no_chunk_outgrows_its_limit_in_a_burst(spark):
    chunk_rows = 10_000
    for spread in (1, 0):
        df = _burst(spark, spread)
        sizes = (ordered.chunk_plan(df, "machine_id", ["timestamp", "reading_id"], chunk_rows)
                 .groupBy("machine_id", "_chunk").agg(F.count("*").alias("n"), F.min(F.struct("timestamp", "reading_id")).alias("lo"),
                                                     F.max(F.struct("timestamp", "reading_id")).alias("hi")).collect())
        assert sum(r.n for r in sizes) == 240_000
        assert max(r.n for r in sizes) <= chunk_rows
        assert len(sizes) < 3 * 4 * 240_000 / chunk_rows
        for m in (1, 2):                                 # chunks follow the order
            own = sorted((r for r in sizes if r.machine_id == m), key=lambda r: r._chunk)
            assert all(a.hi < b.lo for a, b in zip(own, own[1:]))


def test_a_string_tie_break_cuts_an_instant(spark):
    df = spark.range(5_000).select(
        F.lit(1).alias("machine_id"), F.lit(5.0).alias("t"), F.format_string("r%05d", "id").alias("name"))
    sizes = ordered.chunk_plan(df, "machine_id", ["t", "name"], 1_000).groupBy("_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 1_000


def test_positions_and_frames_across_a_burst(spark):
    df = _burst(spark, 0).filter("reading_id % 40 = 3 or reading_id < 10")
    cols = ["machine_id", "reading_id", "lag_1h", "lag_24h", "rolling_max_24h", "_ord"]
    plain = windows.window_features(df, chunk_rows=10**9, keep_position=True).select(*cols)
    cut = windows.window_features(df, chunk_rows=200, keep_position=True).select(*cols)
    assert plain.count() == cut.count() == cut.intersect(plain).count()
