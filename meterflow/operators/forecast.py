"""Forecasting model (M1-M6, M9) and load forecasts (A4 -> X3).

A Spark ML pipeline: ``VectorAssembler`` (invalid rows skipped) ->
``StandardScaler`` (mean and std) -> ``GBTRegressor`` (30 trees, depth 5,
step 0.1, seed 42).  Training is distributed; one model covers all machines
(the machine's own history enters through lag and rolling features).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from meterflow import constants as K


def hash_split(df: DataFrame, keys: list[str], train_fraction: float = K.TRAIN_SPLIT,
               seed: int = K.SEED) -> tuple[DataFrame, DataFrame]:
    """M4: a train/test split that depends only on the row keys, not on how
    the data is partitioned (``randomSplit`` follows partitioning)."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(10_000))
    cut = int(round(train_fraction * 10_000))
    return df.filter(bucket < cut), df.filter(bucket >= cut)


def build_pipeline(features: list[str] = K.FEATURE_COLS, label: str = K.LABEL_COL):
    """M1-M3."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="skip"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        GBTRegressor(featuresCol="features", labelCol=label, maxIter=K.GBT_MAX_ITER,
                     maxDepth=K.GBT_MAX_DEPTH, stepSize=K.GBT_STEP_SIZE, seed=K.SEED),
    ])


def fit_forecaster(train: DataFrame, features: list[str] = K.FEATURE_COLS,
                   label: str = K.LABEL_COL, min_rows: int = K.MIN_TRAIN_ROWS):
    """Fit the pipeline; fewer than ``min_rows`` training rows are an error.
    The training rows are computed once: the fit passes over them many times."""
    train = train.select(*features, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if train.limit(min_rows).count() < min_rows:
            raise ValueError(f"a forecast model needs at least {min_rows} training rows")
        return build_pipeline(features, label).fit(train)
    finally:
        train.unpersist()


# --- the fitted trees as tables (M3, M5) ---------------------------------------------------

def tree_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A saved pipeline (``PipelineModel.write``) as two tables.

    ``scaler``: (feature, name, mean, factor), a row a feature; a feature's
    value enters the trees as ``(x - mean) * factor``.  ``nodes``: (tree, weight,
    node, feature, threshold, left, right, prediction, gain, rows), a row a
    node; a leaf has left = -1, an inner node sends values up to the threshold
    to the left.  Both are bounded by the model's settings, not by data."""
    from pyspark.ml import PipelineModel

    model = PipelineModel.load(path)
    assembler, scaling, trees = model.stages
    std, mean = scaling.std.toArray(), scaling.mean.toArray()
    scaler = spark.createDataFrame(
        [(i, n, float(m), 1.0 / float(s) if s != 0 else 0.0)
         for i, (n, m, s) in enumerate(zip(assembler.getInputCols(), mean, std))],
        "feature int, name string, mean double, factor double")
    stage = f"{path}/stages/{len(model.stages) - 1}_{trees.uid}"
    weights = spark.read.parquet(f"{stage}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))
    nodes = spark.read.parquet(f"{stage}/data").select(F.col("treeID").alias("tree"), "nodeData.*").select(
        "tree", F.col("id").alias("node"), F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"), "prediction", "gain", F.col("rawCount").alias("rows"))
    return scaler, nodes.join(weights, "tree")


def predict_by_table(df: DataFrame, scaler: DataFrame, nodes: DataFrame, keys: list[str],
                     depth: int = K.GBT_MAX_DEPTH, out: str = "prediction") -> DataFrame:
    """M5 without the fitted model in memory: (keys, ``out``) for the rows of
    ``df`` whose features are all there, from the tables of ``tree_tables``.

    Every row starts at the root of every tree and goes down one level a join
    with the nodes; a leaf stays where it is.  The weighted predictions of the
    leaves are then added per row.  ``keys`` tell rows apart."""
    names = [r["name"] for r in scaler.orderBy("feature").select("name").collect()]     # the model's columns
    values = F.transform(F.array(*[F.col(n).cast("double") for n in names]), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    whole = df.dropna(subset=names).where(" and ".join(f"not isnan(`{n}`)" for n in names))
    by_feature = F.broadcast(scaler.agg(F.array_sort(F.collect_list(F.struct("feature", "mean", "factor"))).alias("s")))
    state = (whole.select(*keys, values.alias("v")).crossJoin(by_feature)
             .withColumn("x", F.transform("v", lambda e: (e["x"] - F.get("s", e["i"])["mean"]) * F.get("s", e["i"])["factor"]))
             .drop("v", "s")
             .crossJoin(F.broadcast(nodes.select("tree").distinct())).withColumn("node", F.lit(0)))
    inner = F.broadcast(nodes.select("tree", "node", "feature", "threshold", "left", "right"))
    for _ in range(depth):
        state = state.join(inner, ["tree", "node"]).withColumn(
            "node", F.when(F.col("left") < 0, F.col("node"))
            .when(F.get("x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        ).drop("feature", "threshold", "left", "right")
    leaves = F.broadcast(nodes.select("tree", "node", (F.col("prediction") * F.col("weight")).alias("_p")))
    return state.join(leaves, ["tree", "node"]).groupBy(*keys).agg(F.sum("_p").alias(out))


def importance_by_table(scaler: DataFrame, nodes: DataFrame) -> DataFrame:
    """M6 + O6 from the node table: a feature's share of all the trees' gains,
    each weighted by the rows that reached the node."""
    gains = nodes.where("left >= 0").groupBy("feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("g"))
    total = gains.agg(F.sum("g").alias("t"))
    return scaler.join(gains, "feature", "left").crossJoin(F.broadcast(total)).select(
        F.col("name").alias("feature"), F.coalesce(F.col("g") / F.col("t"), F.lit(0.0)).alias("importance")
    ).orderBy(F.col("importance").desc(), "feature")


def regression_metrics(pred: DataFrame, label: str = K.LABEL_COL,
                       prediction: str = "prediction") -> DataFrame:
    """RMSE, MAE and R^2 as one aggregate pass (no driver loop)."""
    err = F.col(prediction) - F.col(label)
    stats = pred.agg(
        F.count(F.lit(1)).alias("n_test"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("_ss_res"),
        (F.sum(F.col(label) * F.col(label)) - F.sum(label) * F.sum(label) / F.count(label)).alias("_ss_tot"),
    )
    return stats.select("n_test", "rmse", "mae",
                        (1 - F.col("_ss_res") / F.col("_ss_tot")).alias("r2"))


def feature_importance(spark: SparkSession, model, features: list[str] = K.FEATURE_COLS) -> DataFrame:
    """M6 + O6: importances of the fitted trees, largest first."""
    imp = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature")


def peak_next_hours(forecast: DataFrame, now: DataFrame, key: str = "machine_id",
                    hours: int = 48, hour: str = "hour",
                    value: str = "predicted_load_next_24h") -> DataFrame:
    """Expected peak over the next ``hours`` hours per machine, from the
    hourly forecast profile.  Each machine's next hours are generated with
    ``sequence`` from its own last timestamp (``now``: key, ts), joined to
    its 24-hour profile and reduced with ``max_by`` -- a partial aggregate."""
    steps = now.select(
        key, F.explode(F.sequence(F.lit(1), F.lit(hours))).alias("step"), "ts")
    steps = steps.select(
        key, "step",
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.col("step"))).alias("at"))
    steps = steps.withColumn(hour, F.hour("at").cast("int"))
    joined = steps.join(forecast.select(key, hour, value), [key, hour])
    return joined.groupBy(key).agg(
        F.max(value).alias("peak_kwh"),
        F.min_by("at", F.struct(-F.col(value), F.col("at"))).alias("peak_at"))
