"""The whole model bundle on disk.

A bundle is what the scoring jobs need: the scaler's bounds, the thresholds,
the bottleneck (one for all machines, or one a machine) and, if there is one,
the forecast pipeline.  Every save goes to a folder of its own and ends with one
append to the manifest that names its parts, so a reader sees the old bundle or
the new one, never a half-written one, and a job that was lost leaves the old
one in place.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.operators import sequence
from meterflow.sources.files import path_exists

MANIFEST_SCHEMA = "part string, version string, rows long, saved long"
PARTS = ("bounds", "thresholds", "model", "models", "forecast")


@dataclass
class Bundle:
    """A loaded bundle; parts it does not have are None."""

    path: str
    version: str
    bounds: DataFrame | None = None
    thresholds: DataFrame | None = None
    scorer: sequence.PcaScorer | None = None
    models: DataFrame | None = None
    forecaster: object | None = None

    def score(self, windows: DataFrame, arr: str = "scaled_readings", out: str = "recon_error") -> DataFrame:
        """Scaled windows (batch or stream) scored by the bundle's model."""
        if self.models is not None:
            return sequence.score_per_machine(windows, self.models, arr=arr, out=out)
        if self.scorer is None:
            raise ValueError(f"the bundle {self.path} has no bottleneck")
        return sequence.score(windows, self.scorer, arr=arr, out=out)


def save(spark: SparkSession, path: str, bounds: DataFrame | None = None, thresholds: DataFrame | None = None,
         scorer: sequence.PcaScorer | None = None, models: DataFrame | None = None, forecaster=None) -> str:
    """Write a bundle and return its version.  Tables are written as they are;
    a part that is None is not in the bundle."""
    version = uuid.uuid4().hex
    root, rows = f"{path}/{version}", []
    if all(p is None for p in (bounds, thresholds, scorer, models, forecaster)):
        raise ValueError("a bundle needs a part")
    tables = {"bounds": bounds, "thresholds": thresholds, "models": models,
              "model": scorer.to_frame(spark) if scorer is not None else None}
    for part, table in tables.items():
        if table is not None:
            table.write.parquet(f"{root}/{part}")
            rows.append((part, version, spark.read.parquet(f"{root}/{part}").count()))
    if forecaster is not None:
        forecaster.write().save(f"{root}/forecast")
        rows.append(("forecast", version, 1))
    saved = time.time_ns()
    spark.createDataFrame([(*r, saved) for r in rows], MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(
        f"{path}/manifest")
    return version


def _manifest(spark: SparkSession, path: str) -> tuple[str, dict[str, int]]:
    """The version saved last and its parts with their rows."""
    if not path_exists(spark, f"{path}/manifest"):
        raise FileNotFoundError(f"no bundle at {path}")
    rows = (spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest").groupBy("version", "saved")
            .agg(F.collect_list(F.struct("part", "rows")).alias("parts")).orderBy(F.desc("saved"), "version").limit(1).collect())
    return rows[0]["version"], {p["part"]: p["rows"] for p in rows[0]["parts"]}


def part_path(spark: SparkSession, path: str, part: str) -> str:
    """The folder of one part of the current bundle."""
    if part not in PARTS:
        raise ValueError(f"a bundle has no part {part!r}")
    return f"{path}/{_manifest(spark, path)[0]}/{part}"


def load(spark: SparkSession, path: str) -> Bundle:
    """The current bundle at ``path``; its tables are checked against the manifest."""
    version, manifest = _manifest(spark, path)
    bundle = Bundle(path, version)
    for part, rows in manifest.items():
        folder = f"{path}/{version}/{part}"
        if part == "forecast":
            from pyspark.ml import PipelineModel
            bundle.forecaster = PipelineModel.load(folder)
            continue
        table = spark.read.parquet(folder)
        if (found := table.agg(F.count(F.lit(1))).first()[0]) != rows:
            raise ValueError(f"part {part} of the bundle {path} has {found} rows, its manifest says {rows}")
        if part == "model":
            bundle.scorer = sequence.PcaScorer.from_frame(table)
        else:
            setattr(bundle, part, table)
    return bundle
