"""Scoring requests, alerts, logs and event feeds (P9-P14, P16, R7-R9, J3,
O3, O5, D10, D14).

The reference does these one request at a time inside a service; here each is
a table operator over many requests at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterflow import constants as K
from meterflow.functions import columns as C
from meterflow.operators.ordered import ORD, ordered_frames
from meterflow.operators.prep import sized_broadcast
from meterflow.operators.windows import last_n_per_key


# --- requests ------------------------------------------------------------------------

def request_frames(readings: DataFrame, key: str = "machine_id", ts: str = "timestamp",
                   value: str = "kwh", tiebreak: str | None = "reading_id",
                   length: int = K.WINDOW, chunk_rows: int | None = None) -> DataFrame:
    """One scoring request per reading: the next ``length`` readings of the
    machine (shorter near the end, as a feed would cut them), with the
    emulator's forecast ``last * 1.05``."""
    order = [ts] + ([tiebreak] if tiebreak else [])

    def build(w):
        f = w.rowsBetween(0, length - 1)
        return {"readings": F.collect_list(value).over(f), "request_ts": F.last(ts).over(f)}

    out = ordered_frames(readings, key, order, build, halo=length, chunk_rows=chunk_rows)
    return out.select(
        F.col(key).alias("machine_id"), F.col(ORD).alias("window_start"), "request_ts",
        "readings", (C.last_element("readings") * K.FORECAST_UPLIFT).alias("predicted_kwh"))


def validate_requests(df: DataFrame, machine_id: str = "machine_id", readings: str = "readings",
                      predicted: str = "predicted_kwh") -> DataFrame:
    """Add ``rejection`` (null when valid) and ``is_valid``; rejected
    rows stay in the table with their reason instead of raising."""
    return (df.withColumn("rejection", C.request_rejection(machine_id, readings, predicted))
            .withColumn("is_valid", F.col("rejection").isNull()))


# --- alert decision and document --------------------------------------------------------

def decide_alerts(df: DataFrame, error: str = "recon_error", threshold: str = "threshold",
                  readings: str = "readings", predicted: str = "predicted_kwh",
                  spike_factor: float = K.SPIKE_FACTOR) -> DataFrame:
    """R8 + R6 + R7: actual = last reading, forecast defaults to actual;
    flag, alert decision and reason text."""
    out = (df.withColumn("actual_kwh", C.last_element(readings))
           .withColumn("predicted_kwh", F.coalesce(F.col(predicted), F.col("actual_kwh")))
           .withColumn("is_anomaly", F.col(error) > F.col(threshold)))
    return (out.withColumn("alert_fired", C.alert_fired(error, threshold, "actual_kwh",
                                                         "predicted_kwh", spike_factor))
            .withColumn("alert_reason", C.alert_reason(error, threshold, "actual_kwh",
                                                       "predicted_kwh", spike_factor)))


def alert_document(df: DataFrame, machine_id: str = "machine_id", ts: str = "request_ts",
                   spike_factor: float = K.SPIKE_FACTOR) -> DataFrame:
    """The alert attachment as JSON text (title, seven titled fields,
    footer).  The time field is the request's time, so reruns repeat."""
    def field(title, value, short=True):
        return F.struct(F.lit(title).alias("title"), value.alias("value"),
                        F.lit(short).alias("short"))

    def fixed(c, d):
        return F.when(F.col(c).isNotNull(), F.format_string(f"%.{d}f", F.round(F.col(c), d)))

    values = [
        F.col("alert_reason"),
        fixed("actual_kwh", 2),
        fixed("predicted_kwh", 2),
        fixed("recon_error", 6),
        fixed("threshold", 6),
        F.lit(f"{spike_factor}×"),
        F.date_format(ts, K.ALERT_TIME_FORMAT),
    ]
    fields = [field(title, v, short=(title != "Timestamp"))
              for title, v in zip(K.ALERT_FIELD_TITLES, values)]
    attachment = F.struct(
        F.lit(K.ALERT_COLOR).alias("color"),
        F.concat(F.lit(K.ALERT_TITLE_PREFIX), F.col(machine_id).cast("string")).alias("title"),
        F.array(*fields).alias("fields"),
        F.lit(K.ALERT_FOOTER).alias("footer"),
    )
    return df.withColumn("payload", F.to_json(
        F.struct(F.array(attachment).alias("attachments")), {"ignoreNullFields": "false"}))


def scoring_response(df: DataFrame, machine_id: str = "machine_id", ts: str = "request_ts") -> DataFrame:
    """The scoring response per request: rounded error and threshold,
    flag, alert object (sent + reason, as JSON text), latency (not measured
    in batch) and an ISO time with ``Z``."""
    alert = F.to_json(F.struct(F.col("alert_fired").alias("sent"),
                               F.col("alert_reason").alias("reason")),
                      {"ignoreNullFields": "false"})
    return df.select(
        machine_id,
        F.round("recon_error", 6).alias("recon_error"),
        F.round("threshold", 6).alias("threshold"),
        F.col("is_anomaly"),
        alert.alias("alert"),
        F.lit(None).cast("double").alias("latency_ms"),
        F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("timestamp"),
    )


def sample_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """A fixed-size sample with an explicit order (top-n per task, then
    merged), so repeated runs show the same rows."""
    return df.orderBy(*order).limit(n)


# --- logs ------------------------------------------------------------------------------------

def prediction_log(df: DataFrame, ts: str = "request_ts") -> DataFrame:
    """The 9-column prediction log.  ``alert_sent`` records that the
    alert rule fired (delivery is outside the table); ``latency_ms`` is not
    measured in batch and stays null."""
    return df.select(
        F.col(ts).alias("timestamp"), "machine_id",
        F.round("actual_kwh", 3).alias("actual_kwh"),
        F.round("predicted_kwh", 3).alias("predicted_kwh"),
        F.round("recon_error", 6).alias("recon_error"),
        F.round("threshold", 6).alias("threshold"),
        F.col("is_anomaly").cast("int").alias("is_anomaly"),
        F.col("alert_fired").cast("int").alias("alert_sent"),
        F.lit(None).cast("double").alias("latency_ms"),
    )


# --- feeds -----------------------------------------------------------------------------------

def recent_anomalies(log: DataFrame, last_n: int = K.RECENT_DEFAULT, machine_id: int | None = None,
                     ts: str = "timestamp", order: tuple = ("machine_id",)) -> DataFrame:
    """O3: the last ``last_n`` flagged rows (1..500), optionally of one
    machine, in order of arrival with their ``position`` (1 = the oldest of
    them).  ``orderBy(desc).limit`` keeps a top-N per task before merging,
    so no task holds more than N rows."""
    if not 1 <= last_n <= K.RECENT_MAX:
        raise ValueError(f"last_n must be in 1..{K.RECENT_MAX}")
    out = log.filter(F.col("is_anomaly") == 1)
    if machine_id is not None:
        out = out.filter(F.col("machine_id") == machine_id)
    keys = [ts, *order]
    last = out.orderBy(*[F.col(c).desc() for c in keys]).limit(last_n)
    w = Window.orderBy(*[F.col(c) for c in keys])           # over <= last_n rows
    return last.withColumn("position", F.row_number().over(w)).orderBy("position")


def newest_feed(events: DataFrame, capacity: int = K.FEED_CAPACITY, ts: str = "timestamp",
                order: tuple = ("machine_id",)) -> DataFrame:
    """Newest-first bounded feed with its rank (1 = newest)."""
    keys = [ts, *order]
    top = events.orderBy(*[F.col(c).desc() for c in keys]).limit(capacity)
    w = Window.orderBy(*[F.col(c).desc() for c in keys])
    return top.withColumn("feed_rank", F.row_number().over(w))  # over <= capacity rows


def latest_state(log: DataFrame, machines: DataFrame | None = None, key: str = "machine_id",
                 ts: str = "timestamp", order: tuple = ()) -> DataFrame:
    """D14 + P12: one row per machine with its latest reading, flag, error,
    time and status; machines without rows are IDLE.  ``max_by`` is a
    partial aggregate, so a busy machine is not collected in one place."""
    ordering = F.struct(F.col(ts), *[F.col(c) for c in order])
    state = log.groupBy(key).agg(
        F.max_by(F.struct("actual_kwh", "is_anomaly", "recon_error", ts), ordering).alias("s"))
    state = state.select(key, F.col("s.actual_kwh").alias("kwh"),
                         F.col("s.is_anomaly").alias("is_anomaly"),
                         F.col("s.recon_error").alias("recon_error"),
                         F.col(f"s.{ts}").alias("last_updated"))
    if machines is not None:
        state = machines.select(key).distinct().join(state, key, "left")
    return state.withColumn("status", C.status_label("is_anomaly"))


def filter_by_label(df: DataFrame, selection: str, key: str = "machine_id") -> DataFrame:
    """P10 + F7: the feed's machine selector -- ``ALL`` keeps every row,
    ``M-<id>`` keeps that machine (compared as a number, not as text)."""
    if selection == "ALL":
        return df
    return df.filter(F.col(key) == C.machine_from_label(F.lit(selection)))


def label_rates(kpis: DataFrame, key: str = "machine_id", pct: str = "anomaly_rate_pct") -> DataFrame:
    """P13 + F7: display label and rate band on the percentage itself."""
    return kpis.select(
        key, C.machine_label(key).alias("label"), pct,
        C.rate_band(pct).alias("rate_band"))


def normalise_messages(messages: DataFrame) -> DataFrame:
    """Parse relay messages of two shapes (scored data points and alarm
    messages) and fill one event shape: first non-empty of the aliases,
    constant defaults.  A data point gives one event.  An alarm gives an anomaly
    event (``from_alarm``; the alarm has no flag of its own, so it is set), and,
    when it names a machine and brings its readings, the data point of those
    readings too."""
    schema = ("type string, machine_id bigint, kwh double, readings array<double>, "
              "recon_error double, error double, threshold double, is_anomaly boolean, "
              "timestamp string")
    m = messages.withColumn("m", F.from_json("message", schema)).select("m.*")
    is_alarm = F.coalesce(F.col("type") == K.ALARM_TYPE, F.lit(False))
    has_point = ~is_alarm | (F.col("readings").isNotNull() & F.col("machine_id").isNotNull())
    kinds = F.filter(F.array(F.when(has_point, F.lit(False)), F.when(is_alarm, F.lit(True))), lambda k: k.isNotNull())
    m = m.select("*", F.explode(kinds).alias("from_alarm"))
    return m.select(
        "machine_id",
        C.first_nonzero(F.col("kwh"), F.when(~F.col("from_alarm"), C.last_element("readings")),
                        default=F.lit(0.0)).alias("kwh"),
        F.when(F.col("from_alarm"), C.first_nonzero(F.col("error"), F.col("recon_error"), default=F.lit(0.0)))
        .otherwise(C.first_nonzero(F.col("recon_error"), F.col("error"), default=F.lit(0.0))
                   ).alias("recon_error"),
        C.first_nonzero(F.col("threshold"), default=F.lit(K.DEFAULT_THRESHOLD)).alias("threshold"),
        (F.coalesce(F.col("is_anomaly"), F.lit(False)) | is_alarm).alias("is_anomaly"),
        F.col("timestamp"),
        "from_alarm",
    )


def what_if_breakdown(requests: DataFrame, factor: float = K.BREAKDOWN_FACTOR,
                      uplift: float = K.FORECAST_UPLIFT) -> DataFrame:
    """Scale every reading by ``factor`` with a forecast of the base
    last reading x 1.05."""
    return (requests
            .withColumn("predicted_kwh", C.last_element("readings") * uplift)
            .withColumn("readings", C.scale_array("readings", factor)))


def last_window_lookup(readings: DataFrame, machines: DataFrame, key: str = "machine_id",
                       ts: str = "timestamp", value: str = "kwh", tiebreak: str | None = "reading_id",
                       length: int = K.WINDOW, default: float = 150.0) -> DataFrame:
    """Each machine's latest ``length`` readings, or a constant default
    window for machines that have none.  A rank limit keeps at most ``length``
    rows a machine and task before the shuffle."""
    order = [ts] + ([tiebreak] if tiebreak else [])
    last = last_n_per_key(readings, length, key, ts, tiebreak).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_reading")))).alias("_rows"))
    last = last.select(key, F.filter(F.transform("_rows", lambda r: r["_reading"]),
                                     lambda v: v.isNotNull()).alias("last_readings"))
    out = machines.select(key).distinct().join(last, key, "left")
    return out.withColumn("last_readings", F.coalesce(
        F.col("last_readings"), F.array_repeat(F.lit(default), length)))


def attach_limits(df: DataFrame, limits: DataFrame, key: str = "machine_id") -> DataFrame:
    return df.join(sized_broadcast(limits.select(key, "threshold")), key, "left")
