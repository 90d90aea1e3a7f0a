"""Anomaly rules (R1-R6) as column additions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow import constants as K
from meterflow.functions import columns as C


def add_anomaly_flags(df: DataFrame, value: str = "kwh", mean: str = "rolling_avg_24h",
                      std: str = "rolling_std_24h", spike_factor: float = K.SPIKE_FACTOR,
                      drop_factor: float = K.DROP_FACTOR, z_limit: float = K.Z_LIMIT) -> DataFrame:
    """``z_score``, ``spike_flag``, ``drop_flag``, ``zscore_flag`` and
    ``is_anomaly`` (any rule)."""
    return (
        df.withColumn("z_score", C.z_score(value, mean, std))
        .withColumn("spike_flag", C.spike_rule(value, mean, spike_factor))
        .withColumn("drop_flag", C.drop_rule(value, mean, drop_factor))
        .withColumn("zscore_flag", C.z_rule("z_score", z_limit))
        .withColumn("is_anomaly", F.greatest("spike_flag", "drop_flag", "zscore_flag"))
    )
