"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive bytes of their normalised text, longest
radix last: level 0 splits by total length and the first 32 bytes, level k by
a prefix sixteen times longer than that of the level before.  A document
leaves the recursion when its group is a singleton or its bytes have ended;
equal texts are thus found by comparing bytes, never by a digest (the
``text_sha256`` column is only reported).

Each level is one partial aggregation (copies of a hot text collapse on the
map side, so its group arrives as one row a task) and one join of the rows
with their group's count; a hot key of that join is split by the adaptive
skew join.  Only rows that are still undecided carry their text further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FIRST_BYTES = 32
NEXT_BYTES = 8192
GROWTH = 16
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(common.text_of(text_col), common.SPACE, " ")


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with their group's columns.  The groups' length goes through an
    expression, so both sides of the join are shuffles of their own and the
    adaptive skew join can split a hot group's rows over several tasks."""
    groups = groups.select(F.abs("_len").alias("_glen"), F.col("_digit").alias("_gdigit"),
                           *[c for c in groups.columns if c not in ("_len", "_digit")])
    return rows.join(groups, (F.col("_len") == F.col("_glen")) & (F.col("_digit") == F.col("_gdigit")))


def _prefix(name: str, n: int) -> Column:
    return F.substring(F.encode(F.col(name), "UTF-8"), 1, n)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                first_bytes: int = FIRST_BYTES, next_bytes: int = NEXT_BYTES,
                growth: int = GROWTH) -> DataFrame:
    """All rows of ``docs`` with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after each run of ASCII white space became
    one space.  Defined cases: a null text is the empty text, and empty texts
    form one group; null ids sort after all others, so they stay only if every
    copy's id is null; of repeated rows (same id, same text) exactly one has
    kept = true; an empty table gives an empty result; input columns named
    like a result column are replaced by it.
    """
    cols = common.without(docs, *RESULT)
    named = [c for c in docs.columns if c.lower() not in RESULT]
    base = docs.select(F.struct(*cols).alias("_row"), normalised(text_col).alias("_norm"))
    base = base.withColumns({"_len": F.octet_length("_norm"),
                             "_digit": _prefix("_norm", first_bytes)})
    counts = base.groupBy("_len", "_digit").agg(F.count(F.lit(1)).alias("_n"))
    first = common.materialise(
        _with_group(base, counts).select(
            F.monotonically_increasing_id().alias("_rid"), "_row", "_len", "_n",
            F.sha2("_norm", 256).alias("_sha")), "radix_first")

    alive = first.where("_n > 1").select(
        "_rid", F.col("_row")[id_col].alias("_id"), "_len",
        F.regexp_replace(F.coalesce(F.col("_row")[text_col].cast("string"), F.lit("")),
                         common.SPACE, " ").alias("_norm"))
    width, done = next_bytes, None
    while True:
        keyed = alive.withColumn("_digit", _prefix("_norm", width))
        groups = keyed.groupBy("_len", "_digit").agg(
            F.count(F.lit(1)).alias("_size"),
            F.min(F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"),
                           F.col("_rid").alias("rid"))).alias("_first"))
        open_ = (F.col("_size") > 1) & (F.col("_len") > width)
        level = common.materialise(
            _with_group(keyed, groups).select(
                "_rid", "_id", "_len", "_size", "_first", open_.alias("_open"),
                F.when(open_, F.col("_norm")).alias("_norm")), f"radix_{width}")
        ended = level.where("not _open").select("_rid", "_size", "_first")
        done = ended if done is None else done.unionAll(ended)
        alive = level.where("_open").select("_rid", "_id", "_len", "_norm")
        if alive.isEmpty():
            break
        width *= growth

    kept_cols = [F.col("_row")[c].alias(c) for c in named]
    single = first.where("_n = 1").select(
        *kept_cols, F.col("_row")[id_col].alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
    several = first.where("_n > 1").join(done, "_rid").select(
        *kept_cols, F.col("_first.id").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_first.rid") == F.col("_rid")).alias("kept"), F.col("_sha").alias("text_sha256"))
    return single.unionAll(several)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", *RESULT)


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
      FROM documents)
WINDOW g AS (PARTITION BY t)
"""
