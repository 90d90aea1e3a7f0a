"""Helpers of the operators on embedding vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def numbered(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """``df`` written once with ``_rid``: unique, and in the order of ``id_col``
    (nulls last).  Rows of one id are spread by where they come from."""
    return common.materialise(
        df.withColumn("_from", F.monotonically_increasing_id())
        .orderBy(F.col(id_col).asc_nulls_last(), "_from").drop("_from")
        .withColumn("_rid", F.monotonically_increasing_id()), name)


def finite(vector: str) -> Column:
    """Whether a vector is there, not empty, and all its components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def matrix(column, dtype: str) -> np.ndarray:
    """An Arrow binary column of equally long vectors as a matrix."""
    bodies = [x.as_py() for x in column]
    return np.frombuffer(b"".join(bodies), dtype).reshape(len(bodies), -1)
