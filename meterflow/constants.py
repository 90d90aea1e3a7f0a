"""Fixed values that results depend on.

These numbers define the behaviour the library reproduces (rule factors,
window length, split fractions, model settings, log layouts).  They are kept
together, in plain form, so they can be checked at a glance.
"""

# --- fixed values: sequence and window lengths ---------------------------
WINDOW = 24                # readings per sequence (one day of hourly readings)
LATENT_DIM = 8             # bottleneck width of the sequence model
TRAIN_SPLIT = 0.80         # chronological train fraction

# --- fixed values: anomaly rules -----------------------------------------
SPIKE_FACTOR = 1.5         # kwh > 1.5 x rolling mean; also actual > 1.5 x forecast
DROP_FACTOR = 0.2          # kwh < 0.2 x rolling mean (mean > 0)
Z_LIMIT = 3.0              # z-score rule, strict >
THRESHOLD_SIGMAS = 3.0     # threshold = mean + 3 x population std of errors
DRIFT_LIMIT = 0.15         # retrain when round(stddev(z), 4) > 0.15
FORECAST_UPLIFT = 1.05     # hourly forecast = round(avg(kwh) x 1.05, 2)
BREAKDOWN_FACTOR = 3.0     # what-if scale-up of readings
WEEKEND_FACTOR = 0.65      # expected-load weekend reduction
SEASONAL_AMPLITUDE = 0.25  # expected-load seasonal swing

# --- fixed values: rate bands (percent) ------------------------------------
RATE_BAND_LOW = 2.0
RATE_BAND_HIGH = 5.0

# --- fixed values: feeds ---------------------------------------------------
RECENT_DEFAULT = 50        # recent anomalies, default N
RECENT_MAX = 500           # recent anomalies, largest N
FEED_CAPACITY = 200        # newest-first event feed and per-machine history
DEFAULT_THRESHOLD = 0.0979  # threshold used when a relay message carries none

# --- fixed values: text ----------------------------------------------------
NO_ALERT_REASON = "No threshold crossed"
REASON_SEPARATOR = " | "
STATUS_ANOMALY = "ANOMALY"
STATUS_NORMAL = "NORMAL"
STATUS_IDLE = "IDLE"
ALARM_TYPE = "ANOMALY_ALARM"
ALERT_COLOR = "#FF0000"
ALERT_TITLE_PREFIX = "🚨 Energy Anomaly — Machine "
ALERT_FIELD_TITLES = [
    "Reason", "Actual kWh", "Predicted kWh", "Reconstruction Error",
    "Threshold", "Spike Factor", "Timestamp",
]
ALERT_TIME_FORMAT = "yyyy-MM-dd HH:mm 'UTC'"
ALERT_FOOTER = "Energy monitoring"

# --- fixed values: forecasting model ---------------------------------------
FEATURE_COLS = [
    "hour", "dayofweek", "month", "is_weekend",
    "lag_1h", "lag_24h", "rolling_avg_24h",
    "air_temperature",
]
LABEL_COL = "kwh"
GBT_MAX_ITER = 30
GBT_MAX_DEPTH = 5
GBT_STEP_SIZE = 0.1
SEED = 42
MIN_TRAIN_ROWS = 100

# --- fixed values: expected hourly load curve (P15) ------------------------
# (start hour, end hour, base at start, slope per hour)
LOAD_CURVE = [
    (0, 6, 60.0, 0.0),
    (6, 10, 60.0, 18.0),
    (10, 14, 132.0, 0.0),
    (14, 18, 132.0, -12.0),
    (18, 22, 84.0, -8.0),
    (22, 24, 52.0, 0.0),
]

# --- fixed values: log layouts ---------------------------------------------
EDGE_LOG_COLUMNS = [
    "timestamp", "machine_id", "hour_index", "kwh_last",
    "recon_error", "threshold", "is_anomaly",
]
PREDICTION_LOG_COLUMNS = [
    "timestamp", "machine_id", "actual_kwh", "predicted_kwh",
    "recon_error", "threshold", "is_anomaly", "alert_sent", "latency_ms",
]

# --- fixed values: processed readings schema (21 columns) ------------------
PROCESSED_SCHEMA_DDL = (
    "machine_id INT, meter INT, timestamp STRING, kwh DOUBLE, site_id INT, "
    "primary_use STRING, square_feet INT, year_built DOUBLE, floor_count DOUBLE, "
    "air_temperature DOUBLE, cloud_coverage DOUBLE, dew_temperature DOUBLE, "
    "precip_depth_1_hr DOUBLE, sea_level_pressure DOUBLE, wind_direction DOUBLE, "
    "wind_speed DOUBLE, hour INT, month INT, dayofweek INT, is_weekend INT, date STRING"
)
WEATHER_COLUMNS = [
    "air_temperature", "cloud_coverage", "dew_temperature", "precip_depth_1_hr",
    "sea_level_pressure", "wind_direction", "wind_speed",
]
