"""DuckDB SQL equivalents of the registered queries.

The driver tables are views.  Spark's ``round`` rounds the decimal text of
a double half-up; ``r2``/``r4`` do the same (text -> DECIMAL -> round) so
half-way values agree.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def rnd(expr: str, digits: int) -> str:
    return (f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) "
            f"AS DOUBLE)")


def r1(expr: str) -> str:
    return rnd(expr, 1)


def r2(expr: str) -> str:
    return rnd(expr, 2)


def r4(expr: str) -> str:
    return rnd(expr, 4)


def r6(expr: str) -> str:
    return f"round({expr}, 6)"


READINGS = """readings AS (
  SELECT user_id AS machine_id, ts AS "timestamp", value AS kwh, event_id AS reading_id
  FROM events)"""

MONTHLY_READINGS = """mreadings AS (
  SELECT o_custkey % 50 AS machine_id, o_orderdate AS "timestamp",
         o_totalprice AS kwh, o_orderkey AS reading_id
  FROM orders)"""

WIN = 'PARTITION BY machine_id ORDER BY "timestamp", reading_id'


def features_cte(src: str = "readings", name: str = "features") -> str:
    return f"""{name} AS (
  SELECT *,
    lag(kwh, 1) OVER (w) AS lag_1h,
    lag(kwh, 24) OVER (w) AS lag_24h,
    avg(kwh) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS rolling_avg_24h,
    stddev_samp(kwh) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS rolling_std_24h,
    max(kwh) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS rolling_max_24h,
    min(kwh) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS rolling_min_24h
  FROM {src}
  WINDOW w AS ({WIN}))"""


def flags_cte(src: str = "features", name: str = "flagged") -> str:
    return f"""{name}_z AS (
  SELECT *,
    CASE WHEN rolling_std_24h > 0 THEN abs(kwh - rolling_avg_24h) / rolling_std_24h
         ELSE 0.0 END AS z_score,
    CASE WHEN kwh > rolling_avg_24h * 1.5 THEN 1 ELSE 0 END AS spike_flag,
    CASE WHEN rolling_avg_24h > 0 AND kwh < rolling_avg_24h * 0.2 THEN 1 ELSE 0 END AS drop_flag
  FROM {src}),
{name} AS (
  SELECT *, CASE WHEN z_score > 3.0 THEN 1 ELSE 0 END AS zscore_flag,
    greatest(spike_flag, drop_flag, CASE WHEN z_score > 3.0 THEN 1 ELSE 0 END) AS is_anomaly
  FROM {name}_z)"""


FLAGGED = f"WITH {READINGS},\n{features_cte()},\n{flags_cte()}\n"

ORACLE["window_features"] = f"""WITH {READINGS},
{features_cte()}
SELECT machine_id, "timestamp", kwh, reading_id, lag_1h, lag_24h,
  {r6('rolling_avg_24h')} AS rolling_avg_24h, {r6('rolling_std_24h')} AS rolling_std_24h,
  rolling_max_24h, rolling_min_24h
FROM features"""

ORACLE["anomaly_flags"] = FLAGGED + f"""SELECT machine_id, "timestamp", kwh, reading_id,
  {r6('z_score')} AS z_score, spike_flag, drop_flag, zscore_flag, is_anomaly
FROM flagged"""

ORACLE["machine_kpis"] = FLAGGED + f"""SELECT machine_id,
  count(kwh) AS total_readings,
  {r2('avg(kwh)')} AS avg_kwh,
  {r2('max(kwh)')} AS peak_kwh,
  {r2('min(kwh)')} AS min_kwh,
  {r2('stddev_samp(kwh)')} AS std_kwh,
  {r2('quantile_disc(kwh, 0.95)')} AS p95_kwh,
  CAST(sum(is_anomaly) AS BIGINT) AS total_anomalies,
  {r2('sum(is_anomaly) / count(kwh) * 100')} AS anomaly_rate_pct
FROM flagged GROUP BY machine_id"""

# --- step 2: rollups -------------------------------------------------------------

FLAGGED_MONTHLY = (f"WITH {MONTHLY_READINGS},\n{features_cte('mreadings')},\n"
                   f"{flags_cte()}\n")

ORACLE["monthly_trends"] = FLAGGED_MONTHLY + f"""SELECT machine_id,
  CAST(month("timestamp") AS INTEGER) AS month,
  {r2('avg(kwh)')} AS avg_monthly_kwh,
  {r2('sum(kwh)')} AS total_monthly_kwh,
  {r2('max(kwh)')} AS peak_monthly_kwh,
  CAST(sum(is_anomaly) AS BIGINT) AS anomalies_this_month
FROM flagged GROUP BY machine_id, CAST(month("timestamp") AS INTEGER)"""

ORACLE["drift"] = FLAGGED + f"""SELECT machine_id, drift_variance, max_recon_error,
  CASE WHEN drift_variance > 0.15 THEN true ELSE false END AS needs_retrain
FROM (SELECT machine_id, {r4('stddev_samp(z_score)')} AS drift_variance,
             {r6('max(z_score)')} AS max_recon_error
      FROM flagged GROUP BY machine_id)"""

ORACLE["hourly_forecast"] = FLAGGED + f"""SELECT machine_id, CAST(hour("timestamp") AS INTEGER) AS hour,
  {r2('avg(kwh) * 1.05')} AS predicted_load_next_24h
FROM flagged GROUP BY machine_id, CAST(hour("timestamp") AS INTEGER)"""

ORACLE["flag_counts"] = FLAGGED + """SELECT count(*) AS total_rows,
  CAST(coalesce(sum(is_anomaly), 0) AS BIGINT) AS anomaly_count,
  CAST(coalesce(sum(spike_flag), 0) AS BIGINT) AS spike_count,
  CAST(coalesce(sum(drop_flag), 0) AS BIGINT) AS drop_count,
  CAST(coalesce(sum(zscore_flag), 0) AS BIGINT) AS zscore_count
FROM flagged"""

ORACLE["dataset_profile"] = f"""WITH {READINGS}
SELECT count(*) AS n_rows, count(DISTINCT machine_id) AS n_machines,
  min("timestamp") AS first_ts, max("timestamp") AS last_ts,
  {r2('min(kwh)')} AS min_kwh, {r2('max(kwh)')} AS max_kwh,
  CAST(sum(CASE WHEN kwh IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_kwh
FROM readings"""

ORACLE["distinct_machines"] = f"""WITH {READINGS}
SELECT DISTINCT machine_id FROM readings"""

# --- step 3: preparation and joins -------------------------------------------------

RAW_READINGS = """raw AS (
  SELECT o_custkey AS building_id,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS meter,
         o_orderdate AS "timestamp", o_totalprice AS meter_reading, o_orderkey AS reading_id
  FROM orders)"""

METADATA = """meta AS (
  SELECT c_custkey AS building_id, c_nationkey AS site_id, c_mktsegment AS primary_use
  FROM customer)"""

WEATHER = """weather AS (
  SELECT s_nationkey AS site_id, l_shipdate AS "timestamp",
         round(avg(l_quantity), 6) AS air_temperature,
         round(avg(l_discount), 6) AS wind_speed,
         round(avg(l_tax), 6) AS sea_level_pressure
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY s_nationkey, l_shipdate)"""


def calendar_sql(ts: str = '"timestamp"') -> str:
    return (f"CAST(hour({ts}) AS INTEGER) AS hour, CAST(month({ts}) AS INTEGER) AS month, "
            f"CAST(isodow({ts}) - 1 AS INTEGER) AS dayofweek, "
            f"CASE WHEN isodow({ts}) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend, "
            f"CAST({ts} AS DATE) AS date")


ORACLE["scan_filter"] = f"""WITH {RAW_READINGS}, {METADATA}
SELECT * FROM raw
WHERE meter = 0 AND building_id IN (SELECT building_id FROM meta WHERE primary_use = 'MACHINERY')"""

ORACLE["enrich_left_joins"] = f"""WITH {RAW_READINGS}, {METADATA}, {WEATHER}
SELECT r.building_id AS machine_id, r."timestamp", r.meter_reading AS kwh, r.reading_id,
  m.site_id, m.primary_use, w.air_temperature, w.wind_speed, w.sea_level_pressure,
  {calendar_sql('r."timestamp"')}
FROM raw r
LEFT JOIN meta m ON r.building_id = m.building_id
LEFT JOIN weather w ON m.site_id = w.site_id AND w."timestamp" = r."timestamp" """

ORACLE["enrich_bucketed"] = ORACLE["enrich_left_joins"]

ORACLE["calendar_features"] = f"""WITH {READINGS}
SELECT *, {calendar_sql()} FROM readings"""

ORACLE["fill_missing_columns"] = f"""WITH {READINGS}
SELECT *, 20.0::DOUBLE AS air_temperature,
  CAST(hour("timestamp") AS INTEGER) AS hour, CAST(month("timestamp") AS INTEGER) AS month,
  CAST(isodow("timestamp") - 1 AS INTEGER) AS dayofweek,
  CASE WHEN isodow("timestamp") - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend
FROM readings"""

ORACLE["dropna_subset"] = f"""WITH {READINGS},
{features_cte()}
SELECT machine_id, "timestamp", kwh, reading_id, lag_1h, lag_24h,
  {r6('rolling_avg_24h')} AS rolling_avg_24h
FROM features
WHERE lag_1h IS NOT NULL AND lag_24h IS NOT NULL AND rolling_avg_24h IS NOT NULL
  AND kwh IS NOT NULL"""

ORACLE["union_sources"] = f"""WITH {READINGS}, {MONTHLY_READINGS}
SELECT * FROM readings UNION ALL SELECT * FROM mreadings"""


def expected_load_sql(ts: str = '"timestamp"') -> str:
    h = f"hour({ts})"
    base = (f"CASE WHEN {h} < 6 THEN 60.0 WHEN {h} < 10 THEN 60.0 + ({h} - 6) * 18.0 "
            f"WHEN {h} < 14 THEN 132.0 WHEN {h} < 18 THEN 132.0 + ({h} - 14) * -12.0 "
            f"WHEN {h} < 22 THEN 84.0 + ({h} - 18) * -8.0 ELSE 52.0 END")
    weekend = f"CASE WHEN isodow({ts}) - 1 >= 5 THEN 0.65 ELSE 1.0 END"
    seasonal = (f"(1.0 + 0.25 * sin(CAST(month({ts}) - 1 AS DOUBLE) / 12.0 * 2 "
                f"* 3.141592653589793 - 3.141592653589793 / 2))")
    return f"CAST({base} AS DOUBLE) * CAST({weekend} AS DOUBLE) * {seasonal}"


ORACLE["expected_baseline"] = f"""WITH {READINGS}
SELECT machine_id, "timestamp", kwh, reading_id, round({expected_load_sql()}, 6) AS expected_kwh
FROM readings"""

# --- step 4: sequences, scaling, scoring ---------------------------------------------

MWIN = 'PARTITION BY machine_id ORDER BY "timestamp", reading_id'

SCALED = f"""{MONTHLY_READINGS},
bounds AS (
  SELECT *, min(kwh) OVER (PARTITION BY machine_id) AS scale_min,
            max(kwh) OVER (PARTITION BY machine_id) AS scale_max
  FROM mreadings),
scaled AS (
  SELECT *, CASE WHEN scale_max - scale_min = 0 THEN kwh - scale_min
                 ELSE (kwh - scale_min) / (scale_max - scale_min) END AS scaled
  FROM bounds)"""


def seq_summary(l: str = "l") -> str:
    return (f"CAST(len({l}) AS INTEGER) AS seq_len, {l}[1] AS seq_first, {l}[len({l})] AS seq_last, "
            f"round(list_sum({l}), 6) AS seq_sum, "
            f"round(list_sum(list_transform({l}, lambda x, i: x * i)), 6) AS seq_weighted")


def deviation_sql(l: str = "l") -> str:
    return f"list_avg(list_transform({l}, lambda x: abs(x - list_avg({l}))))"


ORACLE["minmax_scale"] = f"""WITH {SCALED}
SELECT machine_id, "timestamp", kwh, reading_id, scale_min, scale_max,
  round(scaled, 6) AS scaled
FROM scaled"""

ORACLE["sequence_windows"] = f"""WITH {READINGS},
w AS (
  SELECT machine_id, "timestamp" AS window_start_ts,
    row_number() OVER ({MWIN}) - 1 AS window_start,
    count(*) OVER (PARTITION BY machine_id) AS n,
    last("timestamp") OVER ({MWIN} ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS window_end_ts,
    list(kwh) OVER ({MWIN} ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS l
  FROM readings)
SELECT machine_id, window_start, window_start_ts, window_end_ts, {seq_summary()}
FROM w WHERE window_start < n - 24"""

SCALED_WINDOWS = f"""{SCALED},
w AS (
  SELECT machine_id,
    row_number() OVER ({MWIN}) - 1 AS window_start,
    count(*) OVER (PARTITION BY machine_id) AS n,
    list(scaled) OVER ({MWIN} ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS l
  FROM scaled),
ws AS (
  SELECT machine_id, window_start, n - 24 AS n_windows,
    CASE WHEN window_start < floor((n - 24) * 0.8) THEN 'train' ELSE 'validation' END AS split,
    l, {deviation_sql()} AS recon_error
  FROM w WHERE window_start < n - 24),
limits AS (
  SELECT machine_id, avg(recon_error) AS error_mean, stddev_pop(recon_error) AS error_std,
    count(recon_error) AS n_errors,
    avg(recon_error) + 3.0 * stddev_pop(recon_error) AS threshold
  FROM ws WHERE split = 'validation' GROUP BY machine_id)"""

ORACLE["chrono_split"] = f"""WITH {SCALED_WINDOWS}
SELECT machine_id, window_start, n_windows, split FROM ws"""

ORACLE["edge_windows"] = f"""WITH {MONTHLY_READINGS},
w AS (
  SELECT machine_id, "timestamp" AS timestamp_last, kwh AS kwh_last,
    row_number() OVER ({MWIN}) AS hour_index,
    count(*) OVER (PARTITION BY machine_id) AS n,
    list(kwh) OVER ({MWIN} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS l
  FROM mreadings)
SELECT machine_id, hour_index, timestamp_last, kwh_last, {seq_summary()}
FROM w
WHERE hour_index >= floor(n * 0.8) + 24 AND hour_index < n"""

ORACLE["baseline_scores"] = f"""WITH {SCALED_WINDOWS}
SELECT machine_id, window_start, split, round(recon_error, 6) AS recon_error FROM ws"""

ORACLE["baseline_threshold"] = f"""WITH {SCALED_WINDOWS}
SELECT machine_id, round(error_mean, 6) AS error_mean, round(error_std, 6) AS error_std,
  n_errors, round(threshold, 6) AS threshold
FROM limits"""

ORACLE["baseline_edge_log"] = f"""WITH {SCALED_WINDOWS},
tail AS (
  SELECT machine_id, "timestamp", kwh,
    row_number() OVER ({MWIN}) AS hour_index,
    count(*) OVER (PARTITION BY machine_id) AS n,
    list(scaled) OVER ({MWIN} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS l
  FROM scaled)
SELECT t."timestamp", t.machine_id, t.hour_index, round(t.kwh, 3) AS kwh_last,
  round({deviation_sql('t.l')}, 6) AS recon_error, round(m.threshold, 6) AS threshold,
  CASE WHEN {deviation_sql('t.l')} > m.threshold THEN 1 ELSE 0 END AS is_anomaly
FROM tail t LEFT JOIN limits m ON t.machine_id = m.machine_id
WHERE t.hour_index >= floor(t.n * 0.8) + 24 AND t.hour_index < t.n"""

# --- the bottleneck model: moments, Jacobi rotations, projection ----------------------

def _moments(src: str, by: str, name: str = "moments") -> str:
    """Mean vector and covariance (row-major list of 576) of the lists ``l``."""
    k, on = (f"{by}, ", f"a.{by} = b.{by} AND ") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    return f"""{name}_x AS (
  SELECT {k}id, unnest(range(24)) AS i, unnest(l) AS x
  FROM (SELECT *, row_number() OVER () AS id FROM {src})),
{name}_mean AS (SELECT {k}list(m ORDER BY i) AS mu FROM (SELECT {k}i, avg(x) AS m FROM {name}_x GROUP BY {k}i) {group}),
{name} AS (
  SELECT {k}list(c ORDER BY i, j) AS a
  FROM (SELECT {f'a.{by}, ' if by else ''}a.i, b.i AS j, coalesce(covar_samp(a.x, b.x), 0.0) AS c
        FROM {name}_x a JOIN {name}_x b ON {on}a.id = b.id GROUP BY ALL) {group})"""


#: Ten sweeps of 23 rounds; a round turns twelve pairs of axes at once, in the
#: order of a round-robin tournament.
ROUNDS = 230


def _rotations(src: str, by: str) -> str:
    """Jacobi's method on the 24 x 24 matrices ``a``: after ROUNDS rounds the
    diagonal of ``a`` has the eigenvalues, the columns of ``v`` the vectors."""
    k = f"{by}, " if by else ""
    own, mate = "a[i * 25 + 1]", "a[mate[i + 1] * 25 + 1]"
    side = "a[i * 24 + mate[i + 1] + 1]"
    return f"""rot AS (
  SELECT {k}0 AS step, a, [CASE WHEN k // 24 = k % 24 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR k IN range(576)] AS v
  FROM {src}
  UNION ALL
  SELECT {k}step + 1,
    [c[k // 24 + 1] * b[k + 1] + g[k // 24 + 1] * b[mate[k // 24 + 1] * 24 + k % 24 + 1] FOR k IN range(576)],
    [c[k % 24 + 1] * v[k + 1] + g[k % 24 + 1] * v[k - k % 24 + mate[k % 24 + 1] + 1] FOR k IN range(576)]
  FROM (SELECT *, [c[k % 24 + 1] * a[k + 1] + g[k % 24 + 1] * a[k - k % 24 + mate[k % 24 + 1] + 1]
                   FOR k IN range(576)] AS b
  FROM (SELECT *, [1 / sqrt(1 + x * x) FOR x IN t] AS c,
          [t[i + 1] / sqrt(1 + t[i + 1] * t[i + 1]) * (CASE WHEN i < mate[i + 1] THEN -1 ELSE 1 END)
           FOR i IN range(24)] AS g
  FROM (SELECT *, [CASE WHEN {side} = 0 THEN 0.0::DOUBLE ELSE
            (CASE WHEN ({mate} - {own}) * (CASE WHEN i < mate[i + 1] THEN 1 ELSE -1 END) * sign({side}) >= 0
                  THEN 1 ELSE -1 END)
            / (abs(({mate} - {own}) / (2 * {side})) + sqrt(1 + power(({mate} - {own}) / (2 * {side}), 2)))
          END FOR i IN range(24)] AS t
  FROM (SELECT *, [CASE WHEN i = 23 THEN step % 23 WHEN i = step % 23 THEN 23
                        ELSE (2 * (step % 23) - i + 46) % 23 END FOR i IN range(24)] AS mate
  FROM rot WHERE step < {ROUNDS})))))"""


def bottleneck_sql(src: str, by: str = "") -> str:
    """``model`` (mu, p): mean and projection on the eight directions of most
    variance (those that have any) of the lists ``l`` in ``src``."""
    k, using = (f"{by}, ", f"JOIN moments_mean USING ({by})") if by else ("", ", moments_mean")
    return f"""{_moments(src, by)},
{_rotations('moments', by)},
model AS (
  SELECT {k}mu, [coalesce(list_sum([v[(k // 24) * 24 + e.i + 1] * v[(k % 24) * 24 + e.i + 1] FOR e IN top]), 0.0)
              FOR k IN range(576)] AS p
  FROM (SELECT *, [e FOR e IN list_reverse_sort([{{'x': a[i * 25 + 1], 'i': i}} FOR i IN range(24)])[1:8]
                   IF e.x > 1e-9 * list_max([a[i * 25 + 1] FOR i IN range(24)])] AS top
        FROM rot {using} WHERE step = {ROUNDS}))"""


def recon_sql(l: str = "l", mu: str = "mu", p: str = "p") -> str:
    return (f"list_avg([abs({mu}[j + 1] + list_sum([({l}[i + 1] - {mu}[i + 1]) * {p}[i * 24 + j + 1] FOR i IN range(24)]) "
            f"- {l}[j + 1]) FOR j IN range(24)])")


def _bottleneck(by: str = "") -> str:
    return f"""WITH RECURSIVE {SCALED_WINDOWS},
trainw AS (SELECT machine_id, l FROM ws WHERE split = 'train'),
{bottleneck_sql('trainw', by)},
scored AS (SELECT machine_id, window_start, split, {recon_sql()} AS recon_error
           FROM ws {f'LEFT JOIN model USING ({by})' if by else ', model'}),
mlimits AS (
  SELECT machine_id, avg(recon_error) AS error_mean, stddev_pop(recon_error) AS error_std,
    count(recon_error) AS n_errors, avg(recon_error) + 3.0 * stddev_pop(recon_error) AS threshold
  FROM scored WHERE split = 'validation' GROUP BY machine_id)"""


for _prefix, _by in (("recon", ""), ("machine_model", "machine_id")):
    ORACLE[f"{_prefix}_scores"] = f"""{_bottleneck(_by)}
SELECT machine_id, window_start, split, round(recon_error, 6) AS recon_error FROM scored"""
    ORACLE["model_threshold" if _prefix == "recon" else f"{_prefix}_threshold"] = f"""{_bottleneck(_by)}
SELECT machine_id, round(error_mean, 6) AS error_mean, round(error_std, 6) AS error_std, n_errors,
  round(threshold, 6) AS threshold
FROM mlimits"""

ORACLE["model_roundtrip"] = f"""{_bottleneck()}
SELECT machine_id, window_start, round(recon_error, 6) AS recon_error FROM scored"""

ORACLE["recon_scores_long"] = ORACLE["recon_scores"]

ORACLE["edge_scores"] = f"""{_bottleneck()},
tail AS (
  SELECT machine_id, "timestamp", kwh,
    row_number() OVER ({MWIN}) AS hour_index,
    count(*) OVER (PARTITION BY machine_id) AS n,
    list(scaled) OVER ({MWIN} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS l
  FROM scaled),
stail AS (SELECT t.*, {recon_sql()} AS recon_error FROM tail t, model
          WHERE hour_index >= floor(n * 0.8) + 24 AND hour_index < n)
SELECT "timestamp", machine_id, hour_index, round(kwh, 3) AS kwh_last,
  round(recon_error, 6) AS recon_error, round(threshold, 6) AS threshold,
  CASE WHEN recon_error > threshold THEN 1 ELSE 0 END AS is_anomaly
FROM stail LEFT JOIN mlimits USING (machine_id)"""

# --- step 5: requests, alerts, logs and feeds ---------------------------------------

FRAME = f"{MWIN} ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING"

ORACLE["validate_requests"] = f"""WITH {READINGS},
f AS (
  SELECT machine_id, row_number() OVER ({MWIN}) - 1 AS window_start,
    list(kwh) OVER ({FRAME}) AS l
  FROM readings),
v AS (
  SELECT machine_id, window_start, CAST(len(l) AS INTEGER) AS n_values,
    CASE WHEN machine_id IS NULL OR machine_id < 0 THEN 'machine_id must be >= 0'
         WHEN len(l) != 24 THEN 'Expected exactly 24 readings, got ' || len(l)
         WHEN len(list_filter(l, lambda x: x IS NULL OR x < 0)) > 0
           THEN 'kWh readings cannot be negative'
         WHEN l[len(l)] * 1.05 < 0 THEN 'predicted_kwh must be >= 0'
    END AS rejection
  FROM f)
SELECT machine_id, window_start, n_values, rejection IS NULL AS is_valid, rejection FROM v"""

SCORED = f"""{SCALED_WINDOWS},
req AS (
  SELECT machine_id, row_number() OVER ({MWIN}) - 1 AS window_start,
    last("timestamp") OVER ({FRAME}) AS request_ts,
    list(kwh) OVER ({FRAME}) AS rl,
    list(scaled) OVER ({FRAME}) AS sl
  FROM scaled),
fc AS (
  SELECT machine_id, CAST(hour("timestamp") AS INTEGER) AS hour,
    {r2('avg(kwh) * 1.05')} AS forecast_kwh
  FROM mreadings GROUP BY machine_id, CAST(hour("timestamp") AS INTEGER)),
sr AS (
  SELECT q.machine_id, q.window_start, q.request_ts, q.rl[24] AS actual_kwh,
    coalesce(fc.forecast_kwh, q.rl[24]) AS predicted_kwh,
    {deviation_sql('q.sl')} AS recon_error, m.threshold
  FROM req q
  LEFT JOIN fc ON q.machine_id = fc.machine_id AND CAST(hour(q.request_ts) AS INTEGER) = fc.hour
  LEFT JOIN limits m ON q.machine_id = m.machine_id
  WHERE len(q.rl) = 24),
dec AS (
  SELECT *, recon_error > threshold AS is_anomaly,
    (recon_error > threshold) OR (predicted_kwh > 0 AND actual_kwh > predicted_kwh * 1.5)
      AS alert_fired,
    concat_ws(' | ',
      CASE WHEN recon_error > threshold THEN printf('recon_error (%.4f) > threshold (%.4f)',
        {r4('recon_error')}, {r4('threshold')}) END,
      CASE WHEN predicted_kwh > 0 AND actual_kwh > predicted_kwh * 1.5 THEN
        printf('actual (%.1f kWh) > 1.5× predicted (%.1f)', {r1('actual_kwh')},
               {r1('predicted_kwh')}) END) AS reasons
  FROM sr),
decided AS (
  SELECT *, CASE WHEN reasons = '' THEN 'No threshold crossed' ELSE reasons END AS alert_reason
  FROM dec),
log AS (
  SELECT request_ts AS "timestamp", machine_id, round(actual_kwh, 3) AS actual_kwh,
    round(predicted_kwh, 3) AS predicted_kwh, round(recon_error, 6) AS recon_error,
    round(threshold, 6) AS threshold, CAST(is_anomaly AS INTEGER) AS is_anomaly,
    CAST(alert_fired AS INTEGER) AS alert_sent, CAST(NULL AS DOUBLE) AS latency_ms
  FROM decided)"""

ORACLE["alert_decision"] = f"""WITH {SCORED}
SELECT machine_id, window_start, is_anomaly, alert_fired, alert_reason FROM decided"""


def _field(title: str, value: str, short: bool = True) -> str:
    return (f"{{'title': '{title}', 'value': {value}, "
            f"'short': {'true' if short else 'false'}}}")


def _fixed(expr: str, digits: int) -> str:
    return f"printf('%.{digits}f', {rnd(expr, digits)})"


ORACLE["alert_json"] = f"""WITH {SCORED}
SELECT machine_id, window_start, CAST(to_json({{'attachments': [{{
  'color': '#FF0000',
  'title': '🚨 Energy Anomaly — Machine ' || CAST(machine_id AS VARCHAR),
  'fields': [
    {_field('Reason', 'alert_reason')},
    {_field('Actual kWh', _fixed('actual_kwh', 2))},
    {_field('Predicted kWh', _fixed('predicted_kwh', 2))},
    {_field('Reconstruction Error', _fixed('recon_error', 6))},
    {_field('Threshold', _fixed('threshold', 6))},
    {_field('Spike Factor', "'1.5×'")},
    {_field('Timestamp', "strftime(request_ts, '%Y-%m-%d %H:%M UTC')", False)}],
  'footer': 'Energy monitoring'}}]}}) AS VARCHAR) AS payload
FROM decided WHERE alert_fired"""

ORACLE["prediction_log"] = f"WITH {SCORED}\nSELECT * FROM log"

ORACLE["scoring_metrics"] = f"""WITH {SCORED}
SELECT count(*) AS total_requests,
  CAST(coalesce(sum(is_anomaly), 0) AS BIGINT) AS total_anomalies,
  CAST(coalesce(sum(alert_sent), 0) AS BIGINT) AS total_alerts,
  {r2('coalesce(sum(is_anomaly), 0) / greatest(count(*), 1) * 100')} AS anomaly_rate_pct,
  {r2('coalesce(sum(latency_ms), 0.0) / greatest(count(*), 1)')} AS avg_latency_ms
FROM log"""

LOG_DESC = ('"timestamp" DESC, machine_id DESC, actual_kwh DESC, predicted_kwh DESC, '
            'recon_error DESC, threshold DESC')

ORACLE["recent_anomalies"] = f"""WITH {SCORED}
SELECT *, CAST(51 - row_number() OVER (ORDER BY {LOG_DESC}) + least(0,
  (SELECT count(*) FROM log WHERE is_anomaly = 1) - 50) AS INTEGER) AS position
FROM log WHERE is_anomaly = 1
QUALIFY row_number() OVER (ORDER BY {LOG_DESC}) <= 50"""

ORACLE["recent_anomalies_of_machine"] = ORACLE["recent_anomalies"].replace(
    "is_anomaly = 1", "is_anomaly = 1 AND machine_id = 0")

ORACLE["newest_feed"] = f"""WITH {SCORED}
SELECT *, CAST(row_number() OVER (ORDER BY {LOG_DESC}) AS INTEGER) AS feed_rank
FROM log WHERE is_anomaly = 1
QUALIFY feed_rank <= 200"""

ORACLE["last_n_per_machine"] = f"""WITH {MONTHLY_READINGS}
SELECT machine_id, "timestamp", kwh, reading_id FROM mreadings
QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY "timestamp" DESC, reading_id DESC) <= 200"""

ORACLE["machine_status"] = f"""WITH {SCORED},
latest AS (
  SELECT machine_id, actual_kwh AS kwh, is_anomaly, recon_error, "timestamp" AS last_updated
  FROM log
  QUALIFY row_number() OVER (PARTITION BY machine_id
                             ORDER BY "timestamp" DESC, actual_kwh DESC, recon_error DESC) = 1),
machines AS (SELECT DISTINCT user_id AS machine_id FROM events)
SELECT m.machine_id, l.kwh, l.is_anomaly, l.recon_error, l.last_updated,
  CASE WHEN l.is_anomaly IS NULL THEN 'IDLE' WHEN l.is_anomaly = 1 THEN 'ANOMALY'
       ELSE 'NORMAL' END AS status
FROM machines m LEFT JOIN latest l ON m.machine_id = l.machine_id"""

ORACLE["rate_band"] = FLAGGED + f""", kpis AS (
  SELECT machine_id, {r2('sum(is_anomaly) / count(kwh) * 100')} AS anomaly_rate_pct
  FROM flagged GROUP BY machine_id)
SELECT machine_id, 'M-' || CAST(machine_id AS VARCHAR) AS label, anomaly_rate_pct,
  CASE WHEN anomaly_rate_pct < 2.0 THEN 'low' WHEN anomaly_rate_pct < 5.0 THEN 'medium'
       ELSE 'high' END AS rate_band
FROM kpis"""

ORACLE["normalise_events"] = f"""WITH {SCORED}
SELECT machine_id, coalesce(nullif(actual_kwh, 0), 0.0) AS kwh,
  coalesce(nullif(recon_error, 0), 0.0) AS recon_error,
  coalesce(nullif(threshold, 0), 0.0979) AS threshold,
  coalesce(is_anomaly = 1, false) AS is_anomaly,
  strftime("timestamp", '%Y-%m-%dT%H:%M:%S') AS "timestamp", false AS from_alarm
FROM log
UNION ALL
SELECT machine_id, 0.0 AS kwh, coalesce(nullif({r4('recon_error')}, 0), 0.0) AS recon_error,
  0.0979 AS threshold, true AS is_anomaly,
  strftime("timestamp", '%Y-%m-%dT%H:%M:%S') AS "timestamp", true AS from_alarm
FROM log WHERE is_anomaly = 1
UNION ALL
SELECT machine_id, coalesce(nullif(actual_kwh, 0), 0.0) AS kwh,
  coalesce(nullif({r4('recon_error')}, 0), 0.0) AS recon_error, 0.0979 AS threshold, true AS is_anomaly,
  strftime("timestamp", '%Y-%m-%dT%H:%M:%S') AS "timestamp", false AS from_alarm
FROM log WHERE is_anomaly = 1 AND machine_id % 2 = 0"""

ORACLE["what_if_scale"] = f"""WITH {MONTHLY_READINGS},
f AS (
  SELECT machine_id, row_number() OVER ({MWIN}) - 1 AS window_start,
    list(kwh) OVER ({FRAME}) AS l
  FROM mreadings)
SELECT machine_id, window_start, l[24] * 3.0 AS breakdown_last,
  round(l[24] * 1.05, 6) AS predicted_kwh,
  round(list_sum(list_transform(l, lambda x: x * 3.0)), 6) AS seq_sum,
  l[24] * 3.0 > l[24] * 1.05 * 1.5 AS spike_alert
FROM f WHERE len(l) = 24"""

ORACLE["request_lookup"] = f"""WITH {MONTHLY_READINGS},
last AS (
  SELECT machine_id, list(kwh) OVER ({MWIN} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS l
  FROM mreadings
  QUALIFY row_number() OVER (PARTITION BY machine_id
                             ORDER BY "timestamp" DESC, reading_id DESC) = 1),
machines AS (SELECT DISTINCT user_id AS machine_id FROM events)
SELECT m.machine_id, CAST(coalesce(len(l.l), 24) AS INTEGER) AS n_values,
  coalesce(l.l[len(l.l)], 150.0) AS last_value,
  coalesce(round(list_sum(l.l), 6), 3600.0) AS seq_sum
FROM machines m LEFT JOIN last l ON m.machine_id = l.machine_id"""

# --- step 8 (part): prose features ---------------------------------------------------

ORACLE["peak_48h"] = FLAGGED + f""", fc AS (
  SELECT machine_id, CAST(hour("timestamp") AS INTEGER) AS hour,
    {r2('avg(kwh) * 1.05')} AS predicted_load_next_24h
  FROM flagged GROUP BY machine_id, CAST(hour("timestamp") AS INTEGER)),
now AS (SELECT machine_id, max("timestamp") AS ts FROM readings GROUP BY machine_id),
steps AS (SELECT machine_id, unnest(generate_series(1, 48)) AS step, ts FROM now),
hours AS (
  SELECT s.machine_id, s.ts + to_hours(s.step) AS at,
    CAST(hour(s.ts + to_hours(s.step)) AS INTEGER) AS hour
  FROM steps s)
SELECT h.machine_id, f.predicted_load_next_24h AS peak_kwh, h.at AS peak_at
FROM hours h JOIN fc f ON h.machine_id = f.machine_id AND h.hour = f.hour
QUALIFY row_number() OVER (PARTITION BY h.machine_id
                           ORDER BY f.predicted_load_next_24h DESC, h.at ASC) = 1"""

ORACLE["adaptive_threshold"] = f"""WITH {READINGS},
pos AS (SELECT *, row_number() OVER ({MWIN}) - 1 AS ord FROM readings),
base AS (
  SELECT machine_id, avg(kwh) AS m, stddev_pop(kwh) AS s,
    avg(kwh) + 3.0 * stddev_pop(kwh) AS threshold
  FROM pos WHERE ord < 24 GROUP BY machine_id),
later AS (
  SELECT p.machine_id, count(*) AS n_after,
    CAST(sum(CASE WHEN p.kwh > b.threshold THEN 1 ELSE 0 END) AS BIGINT) AS n_above
  FROM pos p JOIN base b ON p.machine_id = b.machine_id
  WHERE p.ord >= 24 GROUP BY p.machine_id)
SELECT b.machine_id, round(b.m, 6) AS baseline_mean, round(b.s, 6) AS baseline_std,
  round(b.threshold, 6) AS threshold, coalesce(l.n_after, 0) AS n_after,
  coalesce(l.n_above, 0) AS n_above
FROM base b LEFT JOIN later l ON b.machine_id = l.machine_id"""

ORACLE["last_7_days"] = f"""WITH {READINGS}
SELECT machine_id, "timestamp", kwh, reading_id FROM readings
QUALIFY "timestamp" > max("timestamp") OVER (PARTITION BY machine_id) - INTERVAL 7 DAY"""

ORACLE["lag_correlation"] = f"""WITH {READINGS},
hourly AS (
  SELECT machine_id, date_trunc('hour', "timestamp") AS hour_ts, sum(kwh) AS load
  FROM readings GROUP BY machine_id, date_trunc('hour', "timestamp")),
fleet AS (SELECT hour_ts, sum(load) AS fleet_load FROM hourly GROUP BY hour_ts),
j AS (
  SELECT h.machine_id, h.load, f.fleet_load - coalesce(o.load, 0.0) AS others_next
  FROM hourly h
  JOIN fleet f ON f.hour_ts = h.hour_ts + INTERVAL 1 HOUR
  LEFT JOIN hourly o ON o.machine_id = h.machine_id AND o.hour_ts = h.hour_ts + INTERVAL 1 HOUR)
SELECT machine_id, count(*) AS n_hours, round(corr(load, others_next), 6) AS follow_corr
FROM j GROUP BY machine_id"""

# --- step 7: streaming -----------------------------------------------------------------------

TRAIL = f"{MWIN} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW"

STREAM_LOG = f"""{SCALED_WINDOWS},
trail AS (
  SELECT machine_id, "timestamp", row_number() OVER ({MWIN}) - 1 AS end_ord,
    list(kwh) OVER ({TRAIL}) AS rl, list(scaled) OVER ({TRAIL}) AS sl
  FROM scaled),
st AS (
  SELECT t.machine_id, t."timestamp", t.end_ord, t.rl[24] AS actual_kwh,
    t.rl[24] * 1.05 AS predicted_kwh, {deviation_sql('t.sl')} AS recon_error, m.threshold
  FROM trail t LEFT JOIN limits m ON t.machine_id = m.machine_id
  WHERE t.end_ord >= 23),
slog AS (
  SELECT "timestamp", machine_id, end_ord, round(actual_kwh, 3) AS actual_kwh,
    {rnd('predicted_kwh', 3)} AS predicted_kwh, round(recon_error, 6) AS recon_error,
    round(threshold, 6) AS threshold,
    CAST(recon_error > threshold AS INTEGER) AS is_anomaly,
    CAST((recon_error > threshold)
         OR (predicted_kwh > 0 AND actual_kwh > predicted_kwh * 1.5) AS INTEGER) AS alert_sent,
    CAST(NULL AS DOUBLE) AS latency_ms
  FROM st)"""

ORACLE["stream_windows"] = f"""WITH {MONTHLY_READINGS},
w AS (
  SELECT machine_id, "timestamp" AS window_end_ts, row_number() OVER ({MWIN}) - 1 AS end_ord,
    list(kwh) OVER ({TRAIL}) AS l
  FROM mreadings)
SELECT machine_id, end_ord, window_end_ts, {seq_summary()} FROM w WHERE end_ord >= 23"""

ORACLE["stream_scores"] = f"""WITH {STREAM_LOG}
SELECT machine_id, end_ord, recon_error, threshold, is_anomaly, alert_sent FROM slog"""

ORACLE["stream_metrics"] = f"""WITH {STREAM_LOG}
SELECT count(*) AS total_requests,
  CAST(coalesce(sum(is_anomaly), 0) AS BIGINT) AS total_anomalies,
  CAST(coalesce(sum(alert_sent), 0) AS BIGINT) AS total_alerts,
  {r2('coalesce(sum(is_anomaly), 0) / greatest(count(*), 1) * 100')} AS anomaly_rate_pct,
  {r2('coalesce(sum(latency_ms), 0.0) / greatest(count(*), 1)')} AS avg_latency_ms
FROM slog"""

ORACLE["stream_latest"] = f"""WITH {STREAM_LOG}
SELECT machine_id, actual_kwh AS kwh, is_anomaly, recon_error, "timestamp" AS last_updated
FROM slog
QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY "timestamp" DESC, end_ord DESC) = 1"""

ORACLE["stream_last_n"] = f"""WITH {STREAM_LOG}
SELECT * FROM slog
QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY "timestamp" DESC, end_ord DESC) <= 200"""

ORACLE["stream_snapshot"] = f"""WITH {STREAM_LOG}
SELECT *, CAST(row_number() OVER (ORDER BY "timestamp" DESC, machine_id DESC, end_ord DESC)
  AS INTEGER) AS feed_rank
FROM slog WHERE is_anomaly = 1
QUALIFY feed_rank <= 200"""

ORACLE["stream_dedup"] = f"""WITH {STREAM_LOG}
SELECT DISTINCT machine_id, end_ord, "timestamp", recon_error, threshold
FROM slog WHERE is_anomaly = 1"""

ORACLE["stream_enrich"] = f"""WITH {RAW_READINGS}, {METADATA}
SELECT r.building_id AS machine_id, r."timestamp", r.meter_reading AS kwh, r.reading_id,
  m.site_id, m.primary_use
FROM raw r LEFT JOIN meta m ON r.building_id = m.building_id"""

ORACLE["kpi_stream"] = f"""WITH {READINGS}
SELECT machine_id, count(kwh) AS total_readings,
  {r2('avg(CAST(kwh AS DECIMAL(28, 8)))')} AS avg_kwh,
  {r2('max(kwh)')} AS peak_kwh, {r2('min(kwh)')} AS min_kwh
FROM readings GROUP BY machine_id"""

# --- step 8: sinks and sources round trips -----------------------------------------------

ORACLE["csv_roundtrip"] = ORACLE["machine_kpis"]
ORACLE["log_append"] = ORACLE["prediction_log"]
ORACLE["processed_csv_ingest"] = f"""WITH {READINGS}
SELECT CAST(machine_id AS INTEGER) AS machine_id, "timestamp", kwh, 20.0::DOUBLE AS air_temperature,
  CAST(hour("timestamp") AS INTEGER) AS hour, CAST(month("timestamp") AS INTEGER) AS month,
  CAST(isodow("timestamp") - 1 AS INTEGER) AS dayofweek,
  CASE WHEN isodow("timestamp") - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend
FROM readings WHERE kwh IS NOT NULL AND kwh >= 0"""

# --- remaining presentation operators ---------------------------------------------------

ORACLE["scoring_response"] = f"""WITH {SCORED}
SELECT machine_id, round(recon_error, 6) AS recon_error, round(threshold, 6) AS threshold,
  is_anomaly, CAST(to_json({{'sent': alert_fired, 'reason': alert_reason}}) AS VARCHAR) AS alert,
  CAST(NULL AS DOUBLE) AS latency_ms, strftime(request_ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS "timestamp"
FROM decided"""

ORACLE["global_threshold_flags"] = f"""WITH {SCALED_WINDOWS},
fleet AS (
  SELECT avg(recon_error) + 3.0 * stddev_pop(recon_error) AS t FROM ws WHERE split = 'validation')
SELECT machine_id, window_start, round(recon_error, 6) AS recon_error,
  round(fleet.t, 6) AS fleet_threshold, CAST(recon_error > fleet.t AS INTEGER) AS is_anomaly
FROM ws, fleet"""

ORACLE["anomaly_sample"] = FLAGGED + f"""SELECT machine_id, "timestamp", kwh,
  {r6('rolling_avg_24h')} AS rolling_avg_24h, {r6('z_score')} AS z_score,
  spike_flag, drop_flag, zscore_flag
FROM flagged WHERE is_anomaly = 1
ORDER BY machine_id, "timestamp", reading_id LIMIT 10"""

ORACLE["log_summary"] = f"""SELECT count(*) AS n_total,
  CAST(coalesce(sum(is_anomaly), 0) AS BIGINT) AS n_anomalies
FROM ({ORACLE["baseline_edge_log"]}) edge_log"""

ORACLE["sorted_readings"] = f"""WITH {READINGS}
SELECT * FROM readings ORDER BY machine_id, "timestamp", reading_id"""

# --- file sources and sinks over derived files ---------------------------------------

ORACLE["raw_csv_scan"] = f"""WITH {RAW_READINGS}, {METADATA}
SELECT CAST(building_id AS INTEGER) AS building_id, meter,
  strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", meter_reading
FROM raw
WHERE meter = 0 AND building_id IN (SELECT building_id FROM meta WHERE primary_use = 'MACHINERY')"""

ORACLE["fallback_ingest"] = f"""WITH {READINGS}
SELECT CAST(machine_id AS INTEGER) AS machine_id, "timestamp", kwh,
  CAST(hour("timestamp") AS INTEGER) AS hour,
  CASE WHEN isodow("timestamp") - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend
FROM readings WHERE kwh IS NOT NULL AND kwh >= 0"""

ORACLE["partitioned_table"] = f"""WITH {MONTHLY_READINGS}
SELECT machine_id, "timestamp", kwh, reading_id, CAST(month("timestamp") AS INTEGER) AS month
FROM mreadings"""

ORACLE["alert_records"] = ORACLE["alert_json"].replace(
    "SELECT machine_id, window_start, CAST(to_json(",
    'SELECT machine_id, request_ts AS "timestamp", alert_reason, CAST(to_json(', 1)

ORACLE["stream_windows_batched"] = ORACLE["stream_windows"]
ORACLE["stream_scores_batched"] = ORACLE["stream_scores"]

ORACLE["retrain_last_7_days"] = f"""WITH RECURSIVE {READINGS},
bounded AS (
  SELECT *, min(kwh) OVER (PARTITION BY machine_id) AS lo, max(kwh) OVER (PARTITION BY machine_id) AS hi FROM readings),
escaled AS (SELECT *, CASE WHEN hi - lo = 0 THEN kwh - lo ELSE (kwh - lo) / (hi - lo) END AS x FROM bounded),
ended AS (
  SELECT machine_id, CAST("timestamp" AS DATE) AS day, row_number() OVER ({MWIN}) - 1 AS end_ord,
    list(x) OVER ({MWIN} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS l
  FROM escaled),
recent AS (
  SELECT * FROM (SELECT * FROM ended WHERE end_ord >= 23)
  QUALIFY day > max(day) OVER (PARTITION BY machine_id) - 7),
{bottleneck_sql('recent', 'machine_id')}
SELECT machine_id, end_ord, count(*) OVER (PARTITION BY machine_id) AS n_train,
  round({recon_sql()}, 6) AS recon_error
FROM recent JOIN model USING (machine_id)"""

ORACLE["json_feed"] = f"""WITH {READINGS}
SELECT reading_id, CASE WHEN ok THEN machine_id END AS machine_id, CASE WHEN ok THEN "timestamp" END AS "timestamp",
  CASE WHEN ok THEN kwh END AS kwh, ok AS accepted
FROM (SELECT *, reading_id % 97 <> 0 AS ok FROM readings)"""

ORACLE["csv_rejects"] = f"""WITH {READINGS}
SELECT reading_id, CASE WHEN reason = 'read' THEN CAST(machine_id AS INTEGER) END AS machine_id,
  CASE WHEN reason = 'read' THEN kwh END AS kwh, reason
FROM (SELECT *, CASE WHEN reading_id % 101 = 0 THEN 'malformed' WHEN reading_id % 103 = 0 THEN 'timestamp'
                     WHEN reading_id % 107 = 0 OR kwh IS NULL OR kwh < 0 THEN 'kwh' ELSE 'read' END AS reason
      FROM readings)"""
