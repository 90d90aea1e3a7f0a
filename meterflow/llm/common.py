"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import contextvars
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.session import scratch_path, ship_package

#: The byte class that the query contracts treat as white space.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


_GROUP: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch_group", default=None)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under ``spark.checkpoint.dir`` and return the table
    reread.  Later plans start from these files, so a lost executor neither
    recomputes the steps before nor sees other row ids."""
    spark = df.sparkSession
    path = f"{_GROUP.get() or scratch_path(spark, 'llm')}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_by(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """``materialise`` as a table bucketed by ``key``: grouping it by the key
    needs no shuffle.  The catalog's entry goes, the files stay."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{_GROUP.get() or scratch_path(spark, 'llm')}/{uuid.uuid4().hex}/{name}"
    (df.write.format("parquet").option("compression", "zstd").option("path", path)
     .bucketBy(buckets, key).saveAsTable(table))
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """A query run inside the block removes its shuffle files when it ends.  For
    plans that run once, like that of a table being written; one run again
    would repeat its stages."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def scratch_group(spark: SparkSession):
    """The folder of all tables that ``materialise`` writes inside the block, to
    be removed with ``discard`` once nothing reads them."""
    path = f"{scratch_path(spark, 'llm')}/group-{uuid.uuid4().hex}"
    token = _GROUP.set(path)
    try:
        yield path
    finally:
        _GROUP.reset(token)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder and all tables in it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` but for those an operator is about to add."""
    taken = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]


#: Places of a membership bitmap: its size is the same whatever the input.
BITMAP_BITS = 1 << 23


def bitmap_place(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BITMAP_BITS)) + 1


def bitmap(keys: DataFrame, *cols: str) -> np.ndarray:
    """One bit a place for the places of ``keys``; a filter that lets through
    every key and some others, so an exact join must follow."""
    maps = (keys.select(bitmap_place(*cols).alias("p"))
            .groupBy(F.expr("bitmap_bucket_number(p)").alias("b"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m")).collect())
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in maps:
        at = (row["b"] - 1) * 4096
        bits[at:at + 4096] = np.frombuffer(bytes(row["m"]), np.uint8)
    return bits


def in_bitmap(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each place of ``bitmap_place`` is set."""
    place = place - 1
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def release_memory() -> None:
    """Give what a Python worker has freed back to the system: workers are
    reused, and each would keep the most that any step before took."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def schema_of(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def file_name(path: str) -> str:
    return os.path.basename(path)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
