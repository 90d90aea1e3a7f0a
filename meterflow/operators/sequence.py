"""Sequence scoring: scaling, windows, a bottleneck model, errors and
thresholds (A10-A12, M7-M9, W3/W4/W6 glue).

The reference trains a small sequence autoencoder (24 readings -> 8 latent
values -> 24) and flags a window when its mean absolute reconstruction error
exceeds ``mean + 3 * population std`` of validation errors.  Here the
bottleneck is ``pyspark.ml.feature.PCA(k=8)`` -- the optimal linear
autoencoder for squared error -- fitted by Spark's distributed covariance.
Only the 24-value mean and the 24 x 24 projection reach the driver.

Scorers are pluggable: ``PcaScorer`` (the model) and ``DeviationScorer``
(mean absolute deviation of a window from its own mean, SQL-expressible,
used where results are checked against SQL).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow import constants as K
from meterflow.operators import prep, rollups, windows
from meterflow.operators.prep import sized_broadcast


# --- scaling (A10, F10) --------------------------------------------------------

def fit_minmax(df: DataFrame, key: str | None = "machine_id", value: str = "kwh") -> DataFrame:
    """A10: min and max of the readings, per machine (or globally)."""
    aggs = [F.min(value).alias("scale_min"), F.max(value).alias("scale_max")]
    return df.groupBy(key).agg(*aggs) if key else df.agg(*aggs)


def _scaled(value, lo, hi):
    rng = hi - lo
    return F.when(rng == 0, value - lo).otherwise((value - lo) / rng)


def apply_minmax(df: DataFrame, scaler: DataFrame, key: str | None = "machine_id",
                 value: str = "kwh", out: str = "scaled") -> DataFrame:
    """Scale each reading with its machine's bounds (zero range -> 0)."""
    if key:
        joined = df.join(sized_broadcast(scaler), key, "left")
    else:
        joined = prep.attach_params(df, scaler.select("scale_min", "scale_max"))
    return joined.withColumn(out, _scaled(F.col(value), F.col("scale_min"), F.col("scale_max")))


def scale_window_array(df: DataFrame, arr: str = "readings", out: str = "scaled_readings") -> DataFrame:
    """scale a request's readings array with attached bounds."""
    lo, hi = F.col("scale_min"), F.col("scale_max")
    return df.withColumn(out, F.transform(F.col(arr), lambda x: _scaled(x, lo, hi)))


# --- windows + split -------------------------------------------------------------

def fit_scaler(readings: DataFrame, key: str = "machine_id", ts: str = "timestamp",
               value: str = "kwh", tiebreak: str | None = "reading_id", fit_on: str = "all",
               length: int = K.WINDOW, split: float = K.TRAIN_SPLIT,
               chunk_rows: int | None = None) -> DataFrame:
    """Per-machine scaler bounds.  ``fit_on="all"`` uses every reading (as
    the reference does, validation included); ``"train"`` only the readings
    inside training windows -- positions below ``floor(split*(n-length)) +
    length - 1`` -- which costs one extra ordered pass."""
    if fit_on == "all":
        return fit_minmax(readings, key, value)
    if fit_on != "train":
        raise ValueError("fit_on must be 'all' or 'train'")
    from meterflow.operators.ordered import CNT, ORD, with_ordinal
    order = [ts] + ([tiebreak] if tiebreak else [])
    pos = with_ordinal(readings, key, order, chunk_rows)
    last = F.floor((F.col(CNT) - length) * F.lit(split)) + (length - 1)
    return fit_minmax(pos.filter(F.col(ORD) < last), key, value)


def scaled_windows(readings: DataFrame, key: str = "machine_id", ts: str = "timestamp",
                   value: str = "kwh", tiebreak: str | None = "reading_id",
                   split: float = K.TRAIN_SPLIT, chunk_rows: int | None = None,
                   scaler_fit: str = "all") -> DataFrame:
    """Scale per machine, cut 24-step windows and mark the chronological
    train/validation split of the windows (W3 + W6)."""
    bounds = fit_scaler(readings, key, ts, value, tiebreak, scaler_fit, split=split,
                        chunk_rows=chunk_rows)
    scaled = apply_minmax(readings, bounds, key, value)
    wins = windows.sequence_windows(scaled, key, ts, "scaled", tiebreak, chunk_rows=chunk_rows)
    wins = wins.withColumn("n_windows", F.col("n_readings") - K.WINDOW)
    return windows.chrono_split(wins, key, "window_start", "n_windows", split)


def scaled_edge_windows(readings: DataFrame, key: str = "machine_id", ts: str = "timestamp",
                        value: str = "kwh", tiebreak: str | None = "reading_id",
                        chunk_rows: int | None = None) -> DataFrame:
    """W4 over scaled readings; ``kwh_last`` stays the raw reading."""
    scaled = apply_minmax(readings, fit_minmax(readings, key, value), key, value)
    return windows.edge_windows(scaled, key, ts, "scaled", tiebreak, last_col=value,
                                chunk_rows=chunk_rows)


def scoring_frames(readings: DataFrame, key: str = "machine_id", ts: str = "timestamp",
                   value: str = "kwh", tiebreak: str | None = "reading_id",
                   length: int = K.WINDOW, split: float = K.TRAIN_SPLIT,
                   chunk_rows: int | None = None) -> DataFrame:
    """One window pass for the scoring path: for every reading, the next
    ``length`` raw readings (a request) and their scaled values, plus the
    train/validation split of the full windows (null for the rest).
    Thresholds and requests both come from this pass, so the readings are
    shuffled once for both."""
    from meterflow.operators.ordered import CNT, ORD, ordered_frames

    # a request without a machine is rejected by validation anyway; dropping
    # it first gives the threshold and request branches identical inputs
    readings = readings.filter(F.col(key).isNotNull())
    scaled = apply_minmax(readings, fit_minmax(readings, key, value), key, value)
    order = [ts] + ([tiebreak] if tiebreak else [])

    def build(w):
        f = w.rowsBetween(0, length - 1)
        return {"readings": F.collect_list(value).over(f),
                "scaled_readings": F.collect_list("scaled").over(f),
                "request_ts": F.last(ts).over(f)}

    out = ordered_frames(scaled, key, order, build, halo=length, chunk_rows=chunk_rows)
    n_windows = F.col(CNT) - length
    part = F.when(F.col(ORD) < n_windows, F.when(
        F.col(ORD) < F.floor(n_windows * F.lit(split)), F.lit("train")).otherwise(F.lit("validation")))
    return out.select(F.col(key).alias("machine_id"), F.col(ORD).alias("window_start"),
                      "request_ts", "readings", "scaled_readings",
                      n_windows.alias("n_windows"), part.alias("split"))


# --- scorers (A12, M8) -----------------------------------------------------------

class DeviationScorer:
    """Mean absolute deviation of a window from its own mean (all JVM).

    One ``aggregate`` pass whose start value carries the window mean, so the
    mean is computed once per window, not once per element."""

    name = "deviation"

    def error(self, arr: str = "readings"):
        a = F.col(arr)
        n = F.size(a)
        mean = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / n
        start = F.struct(mean.alias("m"), F.lit(0.0).alias("s"))
        return F.aggregate(
            a, start,
            lambda acc, x: F.struct(acc["m"].alias("m"), (acc["s"] + F.abs(x - acc["m"])).alias("s")),
            lambda acc: acc["s"] / n)


@dataclass
class PcaScorer:
    """Reconstruction through a k-dimensional linear bottleneck:
    ``x_hat = mu + (x - mu) P P^T`` and error ``mean |x_hat - x|``."""

    mean: list
    projection: list   # 24 x 24 matrix P P^T, row-major lists
    k: int = K.LATENT_DIM
    name: str = "pca"

    def error(self, arr: str = "readings"):
        mu = np.asarray(self.mean, dtype=np.float64)
        proj = np.asarray(self.projection, dtype=np.float64)
        width = len(mu)

        @F.pandas_udf("double")
        def recon_error(s: pd.Series) -> pd.Series:
            out = np.full(len(s), np.nan)
            ok = np.fromiter((x is not None and len(x) == width for x in s), bool, len(s))
            if ok.any():
                X = np.stack([np.asarray(x, dtype=np.float64) for x in s[ok]])
                R = mu + (X - mu) @ proj
                out[ok] = np.abs(R - X).mean(axis=1)
            return pd.Series(out)

        return recon_error(F.col(arr))

    def to_frame(self, spark) -> DataFrame:
        """The model as a one-row table (write it with ``.write``)."""
        return spark.createDataFrame(
            [(self.name, self.k, [float(x) for x in self.mean],
              [[float(v) for v in row] for row in self.projection])],
            "model string, k int, mean array<double>, projection array<array<double>>")

    @classmethod
    def from_frame(cls, df: DataFrame) -> "PcaScorer":
        row = df.limit(1).collect()[0]   # one small row
        return cls(list(row["mean"]), [list(r) for r in row["projection"]], row["k"])


def fit_pca_scorer(train: DataFrame, arr: str = "readings", k: int = K.LATENT_DIM) -> PcaScorer:
    """M7: fit the bottleneck on training windows (distributed covariance)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    from pyspark.ml.stat import Summarizer
    from pyspark.storagelevel import StorageLevel

    vecs = train.select(array_to_vector(F.col(arr)).alias("v")).persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        model = PCA(k=k, inputCol="v", outputCol="p").fit(vecs)
        comps = model.pc.toArray()                       # width x k
        mean = vecs.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()
    finally:
        vecs.unpersist()
    proj = comps @ comps.T
    return PcaScorer(mean, proj.tolist(), k)


def score(df: DataFrame, scorer, arr: str = "readings", out: str = "recon_error") -> DataFrame:
    """Add the scorer's error for each window."""
    return df.withColumn(out, scorer.error(arr))


# --- the model as long tables (M8) -------------------------------------------------

def model_long(spark, scorer: PcaScorer) -> tuple[DataFrame, DataFrame]:
    """The bottleneck as tables: means (i, mu) and the projection matrix
    (i, j, w), a row an entry."""
    width = len(scorer.mean)
    means = spark.createDataFrame([(i, float(m)) for i, m in enumerate(scorer.mean)], "i int, mu double")
    entries = [(i, j, float(scorer.projection[i][j])) for i in range(width) for j in range(width)]
    return means, spark.createDataFrame(entries, "i int, j int, w double")


def models_long(models: DataFrame, key: str = "machine_id", width: int = K.WINDOW) -> tuple[DataFrame, DataFrame]:
    """Per-machine bottlenecks (``fit_machine_pca``) as tables with the key."""
    means = models.select(key, F.posexplode("mean").alias("i", "mu"))
    entries = models.select(key, F.posexplode("projection").alias("at", "w")).select(
        key, F.floor(F.col("at") / width).cast("int").alias("i"), (F.col("at") % width).alias("j"), "w")
    return means, entries


def score_long(windows: DataFrame, means: DataFrame, entries: DataFrame, by: str | None = None,
               keys: tuple = ("machine_id", "window_start"), arr: str = "readings",
               out: str = "recon_error") -> DataFrame:
    """M8 as a matrix product of tables: the window's entries (i, x) times the
    projection's (i, j, w), summed by j, against the entries again.

    ``means`` and ``entries`` hold one model (``model_long``) or, with ``by``, one
    a machine (``models_long``).  A model's entries meet in one row (width +
    width^2 values) that is joined to the windows, and the products are summed
    in the window's own row: a window's entries are neither shuffled nor
    spilled, and its columns need no join back by ``keys``, which tell windows
    apart.  Windows that are null, have no model or are not as long as theirs
    get a null error."""
    own = [by] if by else []
    at = lambda field: F.transform(field, lambda e: e["v"])
    column = F.array_sort(F.collect_list(F.struct("i", F.col("w").alias("v"))))
    columns = entries.groupBy(*own, "j").agg(at(column).alias("c"))
    projection = columns.groupBy(*own).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "c"))), lambda e: e["c"]).alias("_proj"))
    centre = means.groupBy(*own).agg(
        at(F.array_sort(F.collect_list(F.struct("i", F.col("mu").alias("v"))))).alias("_mu"))
    if by:
        models = centre.join(projection, by)
        rows = windows.join(sized_broadcast(models), by, "left")
    else:
        rows = windows.crossJoin(F.broadcast(centre.crossJoin(projection)))
    rows = rows.withColumn("_d", F.when(F.size(arr) == F.size("_mu"), F.zip_with(arr, "_mu", lambda x, mu: x - mu)))
    zero = F.lit(0.0)
    product = F.transform("_proj", lambda c: F.aggregate(F.zip_with("_d", c, lambda d, w: d * w), zero, lambda s, v: s + v))
    errors = F.zip_with("_d", product, lambda d, p: F.abs(p - d))
    total = F.aggregate(errors, zero, lambda s, v: s + v)
    return rows.withColumn(out, total / F.size("_mu")).drop("_d", "_mu", "_proj")


# --- thresholds and flags (A11, R6) ---------------------------------------------

def thresholds(scored: DataFrame, by: str | None = "machine_id", error: str = "recon_error",
               split_col: str = "split", fit_on: str = "validation") -> DataFrame:
    """A11 over the validation windows: ``mean + 3 * population std``."""
    return rollups.error_threshold(scored.filter(F.col(split_col) == fit_on), error, by)


def flag_windows(scored: DataFrame, limits: DataFrame, by: str | None = "machine_id",
                 error: str = "recon_error") -> DataFrame:
    """Strict ``error > threshold`` with the machine's threshold."""
    lim = limits.select(*( [by] if by else []), "threshold")
    joined = scored.join(sized_broadcast(lim), by, "left") if by else prep.attach_params(scored, lim)
    return joined.withColumn(
        "is_anomaly", F.when(F.col(error) > F.col("threshold"), F.lit(1)).otherwise(F.lit(0)))


def training_frames(readings: DataFrame, key: str = "machine_id", ts: str = "timestamp",
                    value: str = "kwh", tiebreak: str | None = "reading_id",
                    length: int = K.WINDOW, split: float = K.TRAIN_SPLIT,
                    steps: int | None = None, chunk_rows: int | None = None) -> DataFrame:
    """One window pass for training and the edge simulation: per reading,
    the scaled window starting there (training / validation windows), the
    scaled window ending there (held-out tail) and the raw forward window.
    Windows, thresholds and the tail all come from this pass, so the readings
    are shuffled once (the executed plan reuses the exchange)."""
    from meterflow.operators.ordered import CNT, ORD, ordered_frames

    readings = readings.filter(F.col(key).isNotNull())
    scaled = apply_minmax(readings, fit_minmax(readings, key, value), key, value)
    order = [ts] + ([tiebreak] if tiebreak else [])

    def build(w):
        fwd = w.rowsBetween(0, length - 1)
        return {"readings": F.collect_list("scaled").over(fwd),
                "raw_readings": F.collect_list(value).over(fwd),
                "tail_readings": F.collect_list("scaled").over(w.rowsBetween(-(length - 1), 0))}

    out = ordered_frames(scaled, key, order, build, halo=length, chunk_rows=chunk_rows)
    n_windows = F.col(CNT) - length
    part = F.when(F.col(ORD) < n_windows, F.when(
        F.col(ORD) < F.floor(n_windows * F.lit(split)), F.lit("train")).otherwise(F.lit("validation")))
    hour_index = F.col(ORD) + 1
    start = F.floor(F.col(CNT) * F.lit(split)) + length
    in_tail = (hour_index >= start) & (hour_index < (
        F.col(CNT) if steps is None else F.least(F.col(CNT), start + steps)))
    return out.select(F.col(key).alias("machine_id"), F.col(ORD).alias("window_start"),
                      F.col(ts).alias("timestamp"), F.col(value).alias("kwh"), "readings",
                      "raw_readings", "tail_readings", n_windows.alias("n_windows"),
                      part.alias("split"), hour_index.alias("hour_index"),
                      in_tail.alias("in_tail"))


def frame_windows(frames: DataFrame, length: int = K.WINDOW) -> DataFrame:
    """The train/validation windows of ``training_frames`` (full windows)."""
    full = F.col("split").isNotNull() & (F.size("raw_readings") == length)
    return frames.filter(full).select("machine_id", "window_start", "readings", "n_windows", "split")


def frame_tail(frames: DataFrame) -> DataFrame:
    """The held-out tail of ``training_frames``."""
    return frames.filter("in_tail").select(
        "machine_id", "hour_index", F.col("timestamp").alias("timestamp_last"),
        F.col("kwh").alias("kwh_last"), F.col("tail_readings").alias("readings"))


def edge_log_from(frames: DataFrame, scorer, limits: DataFrame) -> DataFrame:
    """W4 + M8 + R6: the 7-column edge log for the held-out tail of every
    machine.  The timestamp is the last reading's time, so reruns repeat."""
    return edge_log_of(score(frame_tail(frames), scorer), limits)


def edge_log_of(scored_tail: DataFrame, limits: DataFrame) -> DataFrame:
    """The edge log of tail windows that have their error."""
    flagged = flag_windows(scored_tail, limits)
    return flagged.select(
        F.col("timestamp_last").alias("timestamp"), "machine_id",
        "hour_index", F.round("kwh_last", 3).alias("kwh_last"),
        F.round("recon_error", 6).alias("recon_error"),
        F.round("threshold", 6).alias("threshold"), "is_anomaly")


def edge_log(readings: DataFrame, scorer, limits: DataFrame, key: str = "machine_id",
             ts: str = "timestamp", value: str = "kwh", tiebreak: str | None = "reading_id",
             chunk_rows: int | None = None) -> DataFrame:
    """The edge log straight from readings (see ``edge_log_from``)."""
    frames = training_frames(readings, key, ts, value, tiebreak, chunk_rows=chunk_rows)
    return edge_log_from(frames, scorer, limits)


# --- per-machine bottleneck models (M9) -----------------------------------------

MODEL_SCHEMA = "machine_id bigint, n_train long, mean array<double>, projection array<double>"
DEFAULT_MODEL_BROADCAST_BYTES = 256 * 1024 * 1024
#: Share of the largest variance below which a direction counts as having none.
NO_VARIANCE = 1e-9


#: Groups whose sums a task holds before it hands them on.
HELD_GROUPS = 4096


def _few(n: int, width: int) -> bool:
    """Whether ``n`` windows take less room than their sums."""
    return n * width < width + width * (width + 1) // 2


def _sums(X: np.ndarray) -> np.ndarray:
    """Sums of x and of the upper triangle of x x^T over the rows of X."""
    return np.concatenate([X.sum(axis=0), (X.T @ X)[np.triu_indices(X.shape[1])]])


class _Moments:
    """Moments of one group while they are added up."""

    __slots__ = ("n", "windows", "sums")

    def __init__(self):
        self.n, self.windows, self.sums = 0, [], None

    def add(self, X: np.ndarray) -> None:
        self.n += len(X)
        self.windows.append(X)
        if self.sums is not None or not _few(self.n, X.shape[1]):
            more = _sums(np.concatenate(self.windows))
            self.sums, self.windows = more if self.sums is None else self.sums + more, []

    def add_mean(self, n: int, m: np.ndarray) -> None:
        self.n += n
        self.sums = m * n if self.sums is None else self.sums + m * n

    def row(self, width: int) -> np.ndarray:
        if self.sums is None:
            return np.concatenate(self.windows).ravel()
        if self.windows:                             # a mean came after single windows
            self.sums, self.windows = self.sums + _sums(np.concatenate(self.windows)), []
        return self.sums / self.n


def _moments_of(n: int, m: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and second moment (width x width) of a row of moments."""
    if _few(n, width):
        X = m.reshape(-1, width)
        return X.mean(axis=0), X.T @ X / n
    second, upper = np.empty((width, width)), np.triu_indices(width)
    second[upper] = m[width:]
    second.T[upper] = m[width:]
    return m[:width], second


def _add_in_task(by: list[str], width: int, held: int = HELD_GROUPS):
    """A task's rows (by, n, m), added up by group: what a partial aggregate does,
    with at most ``held`` groups at a time."""
    def run(batches):
        groups: dict[tuple, _Moments] = {}
        schema = None

        def out():
            keys = list(groups)
            cols = [pa.array([k[i] for k in keys], schema.field(i).type) for i in range(len(by))]
            rows = [g.row(width) for g in groups.values()]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            m = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows)))
            n = pa.array([g.n for g in groups.values()], pa.int64())
            groups.clear()
            return pa.RecordBatch.from_arrays([*cols, n, m], [*by, "n", "m"])

        for batch in batches:
            schema = batch.schema
            if batch.num_rows == 0:
                continue
            code = np.zeros(batch.num_rows, np.int64)
            for i in range(len(by)):
                column = batch.column(i).dictionary_encode(null_encoding="encode")
                code = code * len(column.dictionary) + column.indices.to_numpy()
            n = batch.column(len(by)).to_numpy()
            m = batch.column(len(by) + 1)
            starts, values = m.offsets.to_numpy(), m.values.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            edges = np.flatnonzero(np.diff(code[order])) + 1
            runs = np.split(order, edges)
            keys = zip(*(batch.column(i).take(pa.array([r[0] for r in runs])).to_pylist() for i in range(len(by))))
            for key, rows in zip(keys, runs):
                group = groups.get(key)
                if group is None:
                    if len(groups) >= held:
                        yield out()
                    group = groups[key] = _Moments()
                few = [values[starts[r]:starts[r + 1]] for r in rows if _few(n[r], width)]
                if few:
                    group.add(np.concatenate(few).reshape(-1, width))
                for r in rows:
                    if not _few(n[r], width):
                        group.add_mean(int(n[r]), values[starts[r]:starts[r + 1]])
        if groups:
            yield out()

    return run


def _add_parts(width: int):
    @F.pandas_udf("array<double>")
    def added(counts: pd.Series, values: pd.Series) -> pd.Series:
        """Groups of several parts: the lengths follow from the counts."""
        out = []
        for ns, flat in zip(counts, values):
            if ns is None:
                out.append(None)
                continue
            group, at, full = _Moments(), 0, width + width * (width + 1) // 2
            for n in ns:
                if _few(n, width):
                    group.add(flat[at:at + n * width].reshape(-1, width))
                    at += n * width
                else:
                    group.add_mean(int(n), flat[at:at + full])
                    at += full
            out.append(group.row(width))
        return pd.Series(out)

    return added


def window_moments(windows: DataFrame, by: list[str], arr: str = "readings", width: int = K.WINDOW) -> DataFrame:
    """First and second moments of the windows of each group of ``by``: n and m.

    m holds the mean of x and of the upper triangle of x x^T (324 values at a
    width of 24), or the windows themselves while those are fewer values (13
    windows and less), so a table of moments is never larger than its windows.
    Rows of moments add up (``add_moments``): kept per machine and day, they
    refit any range of days without the windows.  Windows of another length
    are left out."""
    ones = windows.filter(F.size(arr) == width).select(*by, F.lit(1).cast("long").alias("n"), F.col(arr).alias("m"))
    return add_moments(ones, by, width)                  # a window is its own moments


def add_moments(moments: DataFrame, by: list[str], width: int = K.WINDOW) -> DataFrame:
    """Rows of moments added up over the groups of ``by``: in each task first, so
    a machine with a huge share of the rows is summed there, never gathered,
    and only the sums are shuffled."""
    rows = moments.select(*by, F.col("n").cast("long").alias("n"), "m")
    parts = rows.mapInArrow(_add_in_task(by, width), rows.schema).groupBy(*by).agg(
        F.collect_list(F.struct("n", "m")).alias("_p"))
    some = F.when(F.size("_p") > 1, F.col("_p"))
    several = _add_parts(width)(F.transform(some, lambda p: p["n"]), F.flatten(F.transform(some, lambda p: p["m"])))
    return parts.select(*by, F.aggregate("_p", F.lit(0).cast("long"), lambda s, p: s + p["n"]).alias("n"),
                        F.coalesce(several, F.col("_p")[0]["m"]).alias("m"))


def fit_from_moments(moments: DataFrame, key: str = "machine_id", k: int = K.LATENT_DIM,
                     width: int = K.WINDOW) -> DataFrame:
    """One k-dimensional bottleneck per row of moments (one row a machine): the
    eigen-decompositions run per partition, batched with numpy."""
    def eig(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            pairs = [_moments_of(n, np.asarray(m), width) for n, m in zip(pdf["n"], pdf["m"])]
            mu, second = np.stack([p[0] for p in pairs]), np.stack([p[1] for p in pairs])
            n = pdf["n"].to_numpy(dtype=np.float64)[:, None, None]
            cov = (second - mu[:, :, None] * mu[:, None, :]) * np.where(n > 1, n / np.maximum(n - 1, 1), 1.0)
            vals, vecs = np.linalg.eigh(cov)                   # ascending eigenvalues
            # directions without variance carry nothing (fewer than k windows)
            some = vals > NO_VARIANCE * vals[:, -1:]
            top = (vecs * some[:, None, :])[:, :, ::-1][:, :, :k]   # width x k per machine
            proj = np.einsum("mik,mjk->mij", top, top).reshape(len(pdf), -1)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "n_train": pdf["n"].to_numpy(),
                                "mean": list(mu), "projection": list(proj)})

    return moments.select(key, "n", "m").mapInPandas(eig, MODEL_SCHEMA.replace("machine_id", key))


def fit_machine_pca(train: DataFrame, key: str = "machine_id", arr: str = "readings",
                    k: int = K.LATENT_DIM, width: int = K.WINDOW) -> DataFrame:
    """M9: one k-dimensional bottleneck per machine, from the moments of its windows."""
    return fit_from_moments(window_moments(train, [key], arr, width), key, k, width)


def _per_row_error(width: int):
    @F.pandas_udf("double")
    def err(x: pd.Series, mu: pd.Series, proj: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        ok = np.fromiter((a is not None and m is not None and len(a) == width
                          for a, m in zip(x, mu)), bool, len(x))
        if ok.any():
            X = np.stack([np.asarray(a, dtype=np.float64) for a in x[ok]])
            MU = np.stack([np.asarray(m, dtype=np.float64) for m in mu[ok]])
            P = np.stack([np.asarray(p, dtype=np.float64) for p in proj[ok]]).reshape(-1, width, width)
            R = MU + np.einsum("ni,nij->nj", X - MU, P)
            out[ok] = np.abs(R - X).mean(axis=1)
        return pd.Series(out)
    return err


def _lookup_error(bc, width: int):
    @F.pandas_udf("double")
    def err(key: pd.Series, x: pd.Series) -> pd.Series:
        models, out = bc.value, np.full(len(x), np.nan)
        whole = np.fromiter((a is not None and len(a) == width for a in x), bool, len(x))
        rows = np.flatnonzero(whole & key.isin(models.keys()).to_numpy())
        if len(rows) == 0:
            return pd.Series(out)
        X, keys = np.stack([np.asarray(a, dtype=np.float64) for a in x.iloc[rows]]), key.to_numpy()[rows]
        for m in np.unique(keys):                    # one product a machine
            at = np.flatnonzero(keys == m)
            mu, P = models[m]
            out[rows[at]] = np.abs(mu + (X[at] - mu) @ P - X[at]).mean(axis=1)
        return pd.Series(out)
    return err


def score_per_machine(windows: DataFrame, models: DataFrame, key: str = "machine_id",
                      arr: str = "readings", out: str = "recon_error", width: int = K.WINDOW,
                      broadcast_limit: int = DEFAULT_MODEL_BROADCAST_BYTES) -> DataFrame:
    """Score each window with its own machine's bottleneck.

    Models are ``8 * (width + width^2)`` bytes per machine.  When all of them
    fit under ``broadcast_limit`` (checked from the model count, not
    assumed), they are broadcast once and looked up per batch; otherwise each
    window is joined to its machine's model row (no size limit)."""
    per_model = 8 * (width + width * width) + 64
    n_models = models.count()
    if n_models * per_model <= broadcast_limit:
        rows = models.collect()          # bounded by the check above
        table = {r[key]: (np.asarray(r["mean"], dtype=np.float64),
                          np.asarray(r["projection"], dtype=np.float64).reshape(width, width))
                 for r in rows}
        bc = windows.sparkSession.sparkContext.broadcast(table)
        return windows.withColumn(out, _lookup_error(bc, width)(F.col(key), F.col(arr)))
    joined = windows.join(models.select(key, F.col("mean").alias("_mu"),
                                        F.col("projection").alias("_proj")), key, "left")
    return joined.withColumn(out, _per_row_error(width)(F.col(arr), F.col("_mu"), F.col("_proj"))) \
        .drop("_mu", "_proj")
