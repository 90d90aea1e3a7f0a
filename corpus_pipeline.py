"""The corpus pipeline: quality, exact dedup, near dedup, repeated passages, packing."""

from __future__ import annotations

import functools
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meterflow.llm import common, exact_dedup, near_dedup, packing, quality, suffix_dedup  # noqa: E402
from meterflow.session import ship_package  # noqa: E402

#: A document goes only when the model is sure of its low quality: the scores
#: between this and the classifier's own threshold are doubtful cases that stay.
REJECT_BELOW = 0.3


#: Pieces that a packing worker keeps: fewer than by default, as the stages before
#: leave the executors and their Python workers with memory in use.
CACHED_PIECES = 400_000

#: Scratch folder of the stage that ran last.
_LEFT: list[str] = []


def _stage(function):
    """A stage that removes the scratch tables of the stage before: whoever calls
    it has written that stage's rows by then (``docs`` is read from them).  A
    folder that ``docs`` still reads stays."""
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        files = docs.inputFiles() if _LEFT else []
        for path in [p for p in _LEFT if not any(os.path.basename(p) in f for f in files)]:
            common.discard(spark, path)
            _LEFT.remove(path)
        with common.scratch_group(spark) as path:
            out = function(spark, docs, sf_dir)
        _LEFT.append(path)
        return out
    return run_stage


@_stage
def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.  The model is
    trained on labelled rows among ``docs`` that are not held out.  A null or
    empty text gets the score of its features (all 0) like any other, repeated
    rows stay or go together, an empty table stays empty."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score_column(docs, model) >= REJECT_BELOW)


@_stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    return exact_dedup.exact_dedup(docs).where("kept").select(*docs.columns)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest
    doc_id.  Five-word shingles, similarity 0.8 or more.  Null and empty texts
    are no copies of anything, repeated rows stay or go together, an empty table
    stays empty."""
    gone = near_dedup.near_dedup(docs, words=5, share=(80, 100)).where("not kept").select(
        F.col("doc_id").alias("_gone"), "text_hash").distinct()
    text_hash = F.xxhash64(common.text_of("text"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]) & (text_hash == gone["text_hash"]), "left_anti")


@_stage
def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a smaller doc_id also has go; a
    character cut at an edge becomes U+FFFD.  Documents that lose all
    their bytes go; those that had none stay."""
    kept = suffix_dedup.suffix_dedup(docs)
    cut = F.size("removed") > 0
    text = F.when(cut, F.make_valid_utf8(F.col("kept_bytes").cast("string"))).otherwise(F.col("text"))
    kept = kept.where(~cut | (F.octet_length("kept_bytes") > 0)).withColumn("text", text)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(cut, F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, packed into training sequences: a null or
    empty text is one piece of its end token alone, repeated rows are packed
    each, an empty table gives no piece."""
    return packing.packed(docs, CACHED_PIECES)


STAGES = [
    ("quality", reject_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", remove_repeated_passages),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each over what the one before kept; a
    stage's rows are removed when the next one's are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with common.scratch_group(spark) as kept:
            docs = common.materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.discard(spark, before)
        before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
