"""File sources.

CSV inputs are read with explicit types (no inference pass) but matched to
columns *by header name*, so a file with reordered or missing columns is
read correctly; missing columns are then added by ``prep.fill_missing_columns``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow import constants as K
from meterflow.operators import prep

RAW_SCHEMA = "building_id int, meter int, timestamp string, meter_reading double"


def processed_schema() -> T.StructType:
    """The 21-column processed readings schema (parsed when first needed)."""
    return T._parse_datatype_string(K.PROCESSED_SCHEMA_DDL)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` exists on its file system (local, HDFS, object store)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def resolve_source(spark: SparkSession, primary: str, fallback: str | None = None) -> str:
    """The primary input if present, else the fallback, else an error."""
    if path_exists(spark, primary):
        return primary
    if fallback and path_exists(spark, fallback):
        return fallback
    raise FileNotFoundError(f"input not found: {primary}" + (f" or {fallback}" if fallback else ""))


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line (reads one line, no type inference)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


CORRUPT = "_corrupt_record"


def read_csv_by_name(spark: SparkSession, path: str, schema: T.StructType, corrupt: str | None = None) -> DataFrame:
    """Read a headed CSV with the types of ``schema`` for the columns the file
    has, matched by name; columns unknown to ``schema`` are read as strings.
    A folder whose files differ in their header raises instead of mixing columns.
    A value that does not fit its type becomes null; ``corrupt`` names a column
    for the text of such lines."""
    types = {f.name: f.dataType for f in schema.fields}
    header = csv_header(spark, path)
    file_schema = T.StructType([T.StructField(c, types.get(c, T.StringType()), True) for c in header])
    reader = (spark.read.option("header", True).option("nullValue", "")
              .option("mode", "PERMISSIVE").option("enforceSchema", False))
    if corrupt:                                      # all columns are parsed, whichever are asked for
        file_schema = file_schema.add(corrupt, T.StringType())
        reader = reader.option("columnNameOfCorruptRecord", corrupt).option("columnPruning", False)
    return reader.schema(file_schema).csv(path)


def ingest_processed(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """S3 + S4 + P3 + P6: processed readings from CSV.  Timestamps are read
    as wall-clock ``TIMESTAMP_NTZ`` (no session time zone, so no DST shift);
    ones that do not parse become null instead of failing the job under ANSI
    mode.  Null and negative readings are dropped; absent columns get their
    defaults."""
    src = resolve_source(spark, path, fallback)
    df = read_csv_by_name(spark, src, processed_schema())
    if "timestamp" in df.columns:
        df = df.withColumn("timestamp", F.expr("try_cast(`timestamp` AS TIMESTAMP_NTZ)"))
    df = prep.valid_readings(df, "kwh")
    return prep.fill_missing_columns(df)


def ingest_with_rejects(spark: SparkSession, path: str, fallback: str | None = None) -> tuple[DataFrame, DataFrame]:
    """S3 with a quarantine: (readings, rejects); together they hold every line.

    ``rejects`` has the reason and the record of each line that is no reading:
    ``malformed`` (a value that does not fit its column, or too few or many of
    them), ``timestamp`` (a time that does not parse) or ``kwh`` (a missing or
    negative reading).  The record is the line's values as JSON, or the line as
    it stands if its values do not match the header.  Values are read as text
    and cast here: the CSV reader itself looks only at the columns that a query
    asks for, and would find other lines malformed in each.  Both results are
    plans over the same files; write the rejects next to their table."""
    types = {f.name: f.dataType for f in processed_schema().fields}
    text = T.StructType([T.StructField(n, T.StringType()) for n in types])
    df = read_csv_by_name(spark, resolve_source(spark, path, fallback), text, corrupt=CORRUPT)
    columns = [c for c in df.columns if c != CORRUPT]
    typed = {c: F.col(c).try_cast("timestamp_ntz" if c == "timestamp" else types.get(c, T.StringType())) for c in columns}
    lost = {c: F.col(c).isNotNull() & typed[c].isNull() for c in columns}
    malformed = F.col(CORRUPT).isNotNull()
    for c in columns:
        if c != "timestamp":
            malformed = malformed | lost[c]
    reason = F.when(malformed, F.lit("malformed"))
    if "timestamp" in columns:
        reason = reason.when(lost["timestamp"], F.lit("timestamp"))
    if "kwh" in columns:
        reason = reason.when(typed["kwh"].isNull() | (typed["kwh"] < 0), F.lit("kwh"))
    judged = df.withColumn("_reason", reason)
    rejects = judged.filter(F.col("_reason").isNotNull()).select(
        F.col("_reason").alias("reason"), F.coalesce(CORRUPT, F.to_json(F.struct(*columns))).alias("record"))
    good = judged.filter(F.col("_reason").isNull()).select(*[typed[c].alias(c) for c in columns])
    return prep.fill_missing_columns(good), rejects


def read_raw_readings(spark: SparkSession, path: str, meter: int = 0, machines=None) -> DataFrame:
    """S1 + P1: raw readings CSV, one meter type and optionally a machine set;
    the file is split across tasks instead of read in chunks."""
    df = spark.read.option("header", True).schema(RAW_SCHEMA).csv(path)
    return prep.readings_filter(df, meter=meter, keys=machines)


def read_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A dimension CSV with a fixed schema."""
    return spark.read.option("header", True).schema(schema).csv(path)


def read_log(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """Read a log back; an absent log is an empty table, not an error."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def read_result_dir(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every part file of a CSV result folder (not only the first);
    empty when the folder is absent."""
    return read_log(spark, path, schema, "csv")
