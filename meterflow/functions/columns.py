"""Scalar column builders.

Each function returns a ``Column`` built only from ``pyspark.sql.functions``
so it stays inside whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterflow import constants as K


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- calendar (P5) ------------------------------------------------------------

def weekday_mon0(ts: str | Column) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(col(ts)).cast("int")


def is_weekend(ts: str | Column) -> Column:
    return F.when(weekday_mon0(ts) >= 5, F.lit(1)).otherwise(F.lit(0))


def calendar_columns(ts: str | Column) -> dict[str, Column]:
    t = col(ts)
    return {
        "hour": F.hour(t).cast("int"),
        "month": F.month(t).cast("int"),
        "dayofweek": weekday_mon0(t),
        "is_weekend": is_weekend(t),
        "date": F.to_date(t),
    }


# --- anomaly rules (R1-R5) ---------------------------------------------------

def z_score(value: str, mean: str, std: str) -> Column:
    return F.when(col(std) > 0, F.abs(col(value) - col(mean)) / col(std)).otherwise(F.lit(0.0))


def flag(cond: Column) -> Column:
    """1 when ``cond`` holds, else 0 (null counts as not holding)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def spike_rule(value: str, mean: str, factor: float = K.SPIKE_FACTOR) -> Column:
    return flag(col(value) > col(mean) * factor)


def drop_rule(value: str, mean: str, factor: float = K.DROP_FACTOR) -> Column:
    return flag((col(mean) > 0) & (col(value) < col(mean) * factor))


def z_rule(z: str, limit: float = K.Z_LIMIT) -> Column:
    return flag(col(z) > limit)


# --- expected load curve (P15) ----------------------------------------------

def expected_load(ts: str | Column) -> Column:
    """Hourly piecewise base x weekend factor x seasonal sine of the month."""
    t = col(ts)
    hr = F.hour(t)
    base = None
    for lo, hi, start, slope in K.LOAD_CURVE:
        value = F.lit(start) + (hr - lo) * F.lit(slope) if slope else F.lit(start)
        cond = (hr >= lo) & (hr < hi)
        base = F.when(cond, value) if base is None else base.when(cond, value)
    weekend = F.when(weekday_mon0(t) >= 5, F.lit(K.WEEKEND_FACTOR)).otherwise(F.lit(1.0))
    seasonal = 1.0 + K.SEASONAL_AMPLITUDE * F.sin(
        (F.month(t) - 1) / 12.0 * 2 * math.pi - math.pi / 2)
    return base * weekend * seasonal


# --- arrays (F9, F10, A12) -----------------------------------------------------

def last_element(arr: str | Column) -> Column:
    return F.element_at(col(arr), -1)


def scale_array(arr: str | Column, factor: float) -> Column:
    return F.transform(col(arr), lambda x: x * F.lit(factor))


# --- requests and alerts (P9, R6-R9, P11-P13) --------------------------------

def request_rejection(machine_id: str, readings: str, predicted: str) -> Column:
    """Reason a scoring request is rejected, or null when it is valid."""
    r = col(readings)
    return (
        F.when(col(machine_id).isNull() | (col(machine_id) < 0), F.lit("machine_id must be >= 0"))
        .when(r.isNull(), F.lit("readings missing"))
        .when(F.size(r) != K.WINDOW,
              F.format_string(f"Expected exactly {K.WINDOW} readings, got %d", F.size(r)))
        .when(F.exists(r, lambda x: x.isNull() | (x < 0)),
              F.lit("kWh readings cannot be negative"))
        .when(col(predicted).isNotNull() & (col(predicted) < 0),
              F.lit("predicted_kwh must be >= 0"))
    )


def alert_reason(error: str, threshold: str, actual: str, predicted: str,
                 spike_factor: float = K.SPIKE_FACTOR) -> Column:
    """Reasons joined by `` | ``, or the no-alert text.

    Numbers are rounded half-up on their decimal value before formatting, so
    the text does not depend on the binary representation of the double.
    """
    err_part = F.when(
        col(error) > col(threshold),
        F.format_string("recon_error (%.4f) > threshold (%.4f)",
                        F.round(col(error), 4), F.round(col(threshold), 4)))
    spike_part = F.when(
        (col(predicted) > 0) & (col(actual) > col(predicted) * spike_factor),
        F.format_string(f"actual (%.1f kWh) > {spike_factor}× predicted (%.1f)",
                        F.round(col(actual), 1), F.round(col(predicted), 1)))
    joined = F.concat_ws(K.REASON_SEPARATOR, err_part, spike_part)
    return F.when(joined == "", F.lit(K.NO_ALERT_REASON)).otherwise(joined)


def alert_fired(error: str, threshold: str, actual: str, predicted: str,
                spike_factor: float = K.SPIKE_FACTOR) -> Column:
    return (col(error) > col(threshold)) | (
        (col(predicted) > 0) & (col(actual) > col(predicted) * spike_factor))


def status_label(is_anomaly: str | Column) -> Column:
    c = col(is_anomaly)
    return (F.when(c.isNull(), F.lit(K.STATUS_IDLE))
            .when(c.cast("boolean"), F.lit(K.STATUS_ANOMALY))
            .otherwise(F.lit(K.STATUS_NORMAL)))


def rate_band(pct: str | Column) -> Column:
    c = col(pct)
    return (F.when(c < K.RATE_BAND_LOW, F.lit("low"))
            .when(c < K.RATE_BAND_HIGH, F.lit("medium"))
            .otherwise(F.lit("high")))


def first_nonzero(*cols: Column, default: Column | None = None) -> Column:
    """First argument that is neither null nor zero (a JavaScript ``a || b``)."""
    parts = [F.nullif(c, F.lit(0)) for c in cols]
    if default is not None:
        parts.append(default)
    return F.coalesce(*parts)


# --- labels (F7) -------------------------------------------------------------------

def machine_label(key: str | Column) -> Column:
    """``M-<id>`` display label."""
    return F.concat(F.lit("M-"), col(key).cast("string"))


def machine_from_label(label: str | Column) -> Column:
    """Inverse of ``machine_label``: strip the ``M-`` prefix (null if the
    rest is not a number)."""
    return F.regexp_replace(col(label), r"^M-", "").try_cast("long")
