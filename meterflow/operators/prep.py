"""Preparation: filters, renames, calendar features, enrichment joins (P1-P8,
P15, P16, J1-J2, J4, U1)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow import constants as K
from meterflow.functions import columns as C

DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer size estimate of ``df`` (from file sizes and statistics)."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size if isinstance(size, int) else size.toString())


def sized_broadcast(df: DataFrame, limit_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast only if its estimated size is under the
    limit; otherwise leave the join strategy to the planner (sort-merge or
    AQE's runtime choice)."""
    return F.broadcast(df) if estimated_bytes(df) <= limit_bytes else df


# --- filters and projections ---------------------------------------------------

def readings_filter(df: DataFrame, meter_col: str = "meter", meter: int = 0,
                    key: str = "building_id", keys: DataFrame | Iterable | None = None) -> DataFrame:
    """Keep one meter type and, optionally, a machine set.

    ``keys`` may be a literal list (becomes an ``IN`` pushed to the scan) or
    a DataFrame of keys (a left-semi join, sized by the planner)."""
    out = df.filter(F.col(meter_col) == meter)
    if keys is None:
        return out
    if isinstance(keys, DataFrame):
        return out.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_semi")
    return out.filter(F.col(key).isin(list(keys)))


def valid_readings(df: DataFrame, value: str = "kwh", strictly_positive: bool = False) -> DataFrame:
    """Drop null and negative readings (or non-positive ones)."""
    cond = F.col(value) > 0 if strictly_positive else F.col(value) >= 0
    return df.filter(F.col(value).isNotNull() & cond)


def rename_raw(df: DataFrame) -> DataFrame:
    """Raw names to the machine narrative."""
    return df.withColumnsRenamed({"building_id": "machine_id", "meter_reading": "kwh"})


def add_calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """P5: hour, month, day of week (Mon=0), weekend flag (>=5) and date."""
    return df.withColumns(C.calendar_columns(ts))


def fill_missing_columns(df: DataFrame, ts: str = "timestamp",
                         defaults: dict[str, object] | None = None) -> DataFrame:
    """Add a column only when the input lacks it (constant or derived)."""
    cal = C.calendar_columns(ts)
    defaults = defaults or {
        "air_temperature": 20.0,
        "hour": cal["hour"], "month": cal["month"],
        "dayofweek": cal["dayofweek"], "is_weekend": cal["is_weekend"],
    }
    add = {}
    for name, value in defaults.items():
        if name not in df.columns:
            add[name] = value if isinstance(value, Column) else F.lit(value)
    return df.withColumns(add) if add else df


def drop_incomplete(df: DataFrame, subset: Sequence[str] = tuple(K.FEATURE_COLS) + (K.LABEL_COL,)) -> DataFrame:
    """Drop rows null in any of ``subset``."""
    return df.dropna(subset=list(subset))


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Concatenate reading sources by column name, duplicates kept."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def add_expected_load(df: DataFrame, ts: str = "timestamp", name: str = "expected_kwh") -> DataFrame:
    """Expected load from the timestamp (daily curve, weekend, season)."""
    return df.withColumn(name, C.expected_load(ts))


def sort_readings(df: DataFrame, key: str = "machine_id", ts: str = "timestamp",
                  tiebreak: str | None = "reading_id", global_order: bool = False) -> DataFrame:
    """O1: readings in machine/time order.  By default rows are
    dealt out by ranges of (machine, time), so a machine with very many rows
    spans several partitions, each sorted; ``global_order`` asks for a total
    order of the output."""
    cols = [key, ts] + ([tiebreak] if tiebreak else [])
    if global_order:
        return df.orderBy(*cols)
    return df.repartitionByRange(*cols).sortWithinPartitions(*cols)


# --- joins ------------------------------------------------------------------------

def with_metadata(readings: DataFrame, metadata: DataFrame, key: str = "building_id") -> DataFrame:
    """Left join machine metadata on the machine key; the metadata is
    broadcast only when its estimated size is small."""
    return readings.join(sized_broadcast(metadata), key, "left")


def with_weather(sited: DataFrame, weather: DataFrame, site: str = "site_id", ts: str = "timestamp") -> DataFrame:
    """Left join weather on (site, timestamp).  Weather is a large table:
    it joins by shuffle (or AQE broadcast), or without any exchange when both
    sides are tables bucketed by these keys (``sinks.write_bucketed``)."""
    return sited.join(weather, [site, ts], "left")


def enrich(readings: DataFrame, metadata: DataFrame, weather: DataFrame,
           key: str = "building_id", site: str = "site_id", ts: str = "timestamp") -> DataFrame:
    """J1 + J2 in one pass over the readings."""
    return with_weather(with_metadata(readings, metadata, key), weather, site, ts)


def attach_params(df: DataFrame, params: DataFrame) -> DataFrame:
    """Attach a one-row parameter table (scaler bounds, threshold) to every
    row by a broadcast join; nothing is collected.  Of several rows one is
    taken; an empty table attaches nulls."""
    return df.join(F.broadcast(params.limit(1)), F.lit(True), "left")
