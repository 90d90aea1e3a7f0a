"""Hard-negative mining with LEMP-style coordinate pruning.

1. Rows are sorted by length and cut into *length buckets* of at most
   ``bucket_rows``; a bucket holds its unit vectors and, per coordinate, their
   sorted list.
2. Anchors form blocks of about ``anchor_rows``.  A block meets every bucket
   that it searches, as one group a pair (the stated query set against all
   rows, in blocks): for positives blocks and buckets are of one label, for
   negatives both hold all labels.
3. In a bucket a score of ``theta`` asks for a cosine of at least
   ``theta / (anchor length * greatest length)``.  Above 1 the bucket is left
   out.  Else that cosine bounds each of the anchor's *focus* coordinates (its
   largest) to a feasible range; the ranges are looked up in the sorted lists
   and the candidate sets intersected.  What is left is verified by its exact
   integer inner product.
4. Positives: ``theta`` is the running score of the anchor's last kept row, and
   a rank limit over the buckets' best rows ends the search.  Negatives:
   ``theta`` is the least score that any of the anchor's positives admits.

Pruning only ever leaves out rows that cannot qualify, so results are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .vectors import finite, matrix, numbered

POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between this share (a ratio) of the positive's and the positive's.
LEAST_SHARE = (80, 100)
SCALE = 256
BUCKET_ROWS, ANCHOR_ROWS = 4096, 512
FOCUS = 3
_SLACK = 1e-9


def _length(vector: np.ndarray) -> float:
    return float(np.sqrt((vector.astype(np.float64) ** 2).sum()))


class Bucket:
    """Vectors of one length bucket with a sorted list per coordinate."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.ids, self.vectors, self.longest = ids, vectors, lengths.max(initial=0.0)
        unit = vectors / np.where(lengths > 0, lengths, 1)[:, None]
        self.order = np.argsort(unit, axis=0)
        self.lists = np.take_along_axis(unit, self.order, axis=0)
        self.top = float(np.abs(vectors).max(initial=0))
        self.floats = vectors.astype(np.float64)

    def candidates(self, anchor: np.ndarray, length: float, theta: float, focus: int = FOCUS) -> np.ndarray | None:
        """Rows that may reach ``theta`` (None: all of them)."""
        if theta <= 0:
            return None                           # rows at an angle of a quarter turn and more reach it too
        if not length or not self.longest or theta > length * self.longest * (1 + _SLACK):
            return np.zeros(0, np.int64)
        least = min(1.0, theta / (length * self.longest)) - _SLACK
        unit, found = anchor / length, None
        for f in np.argsort(-np.abs(unit))[:focus]:
            spread = np.sqrt(max(0.0, (1 - least ** 2) * (1 - unit[f] ** 2))) + _SLACK
            line = self.lists[:, f]
            # a cosine above ``least`` moves the range towards the anchor's own coordinate
            low = -2.0 if unit[f] <= -least else unit[f] * least - spread
            high = 2.0 if unit[f] >= least else unit[f] * least + spread
            lo, hi = np.searchsorted(line, low, "left"), np.searchsorted(line, high, "right")
            if hi - lo == len(line):
                continue
            inside = np.zeros(len(line), bool)
            inside[self.order[lo:hi, f]] = True
            found = inside if found is None else found & inside
        return None if found is None else np.flatnonzero(found)

    def scores(self, anchor: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
        """Exact integer inner products: in doubles where those hold them."""
        if self.top * np.abs(anchor).max(initial=0) * len(anchor) < 2 ** 53:
            part = self.floats if rows is None else self.floats[rows]
            return (part @ anchor.astype(np.float64)).astype(np.int64)
        part = self.vectors if rows is None else self.vectors[rows]
        return part @ anchor


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The first k by score (highest first) and id."""
    if len(scores) > 4 * k:                       # rows below the k-th score cannot be among them
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _rows_of(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pc.equal(table["kind"], kind))


def _near_rows(k: int):
    """Of each anchor, the best k other rows of one bucket."""
    schema = pa.schema([("aid", pa.int64()), ("rid", pa.int64()), ("score", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        rows, anchors = _rows_of(table, 0), _rows_of(table, 1)
        out: list[list[np.ndarray]] = [[], [], []]
        if rows.num_rows and anchors.num_rows:
            bucket = Bucket(rows["rid"].to_numpy(), matrix(rows["body"], "<i4").astype(np.int64))
            vectors = matrix(anchors["body"], "<i4").astype(np.int64)
            # a first pass over few rows gives each anchor a score to beat
            seen = min(bucket.floats.shape[0], 4 * k)
            for aid, anchor in zip(anchors["rid"].to_numpy(), vectors):
                first = bucket.scores(anchor, np.arange(seen))[bucket.ids[:seen] != aid]
                theta = np.partition(first, len(first) - k)[len(first) - k] if len(first) >= k else -np.inf
                at = bucket.candidates(anchor, _length(anchor), float(theta))
                ids = bucket.ids if at is None else bucket.ids[at]
                scores = bucket.scores(anchor, at)
                other = ids != aid
                ids, scores = ids[other], scores[other]
                best = _best(scores, ids, k)
                for column, values in zip(out, (np.full(len(best), aid), ids[best], scores[best])):
                    column.append(values)
        return pa.table({n: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64())
                         for n, c in zip(schema.names, out)}, schema=schema)

    return run


def _negative_rows(k: int, share: tuple[int, int]):
    """Of each anchor and positive's score, the best k rows of one bucket in its window."""
    schema = pa.schema([("aid", pa.int64()), ("bound", pa.int64()), ("rid", pa.int64()), ("score", pa.int64())])
    low, whole = share

    def run(table: pa.Table) -> pa.Table:
        rows, anchors = _rows_of(table, 0), _rows_of(table, 1)
        out: list[list[np.ndarray]] = [[], [], [], []]
        if rows.num_rows and anchors.num_rows:
            bucket = Bucket(rows["rid"].to_numpy(), matrix(rows["body"], "<i4").astype(np.int64))
            labels = np.array(rows["_g"].to_pylist())
            vectors = matrix(anchors["body"], "<i4").astype(np.int64)
            for aid, own, bounds, anchor in zip(anchors["rid"].to_numpy(), anchors["_g"].to_pylist(),
                                                anchors["bounds"].to_pylist(), vectors):
                bounds = [b for b in bounds if low * b <= whole * b]     # a negative score admits nothing
                if not bounds:
                    continue
                least = -(-low * min(bounds) // whole)         # the least score that some positive admits
                at = bucket.candidates(anchor, _length(anchor), float(least))
                at = np.flatnonzero(labels != own) if at is None else at[labels[at] != own]
                ids, scores = bucket.ids[at], bucket.scores(anchor, at)
                for bound in bounds:
                    fit = np.flatnonzero((scores >= -(-low * bound // whole)) & (scores <= bound))
                    best = fit[_best(scores[fit], ids[fit], k)]
                    for column, values in zip(out, (np.full(len(best), aid), np.full(len(best), bound), ids[best], scores[best])):
                        column.append(values)
        return pa.table({n: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64())
                         for n, c in zip(schema.names, out)}, schema=schema)

    return run


def _bucketed(rows: DataFrame, pure: list[str], bucket_rows: int) -> DataFrame:
    """rows (rid, _g, _d, vec, anchor) sorted by length within the columns
    ``pure``, with a bucket number: a bucket holds neighbours in length with
    equal values there, and at most ``bucket_rows`` of them."""
    kind = rows.schema["_g"].dataType.simpleString()
    schema = common.schema_of(f"rid long, _g {kind}, _d int, body binary, bucket long, anchor boolean")
    at = [("_g", "_d").index(c) + 1 for c in pure]

    def run(batches):
        task, number, last, filled = TaskContext.get().partitionId(), -1, None, 0
        for batch in batches:
            buckets, bodies, vectors = [], [], batch.column(3)
            for i, place in enumerate(zip(*(batch.column(c).to_pylist() for c in at))):
                if place != last or filled == bucket_rows:
                    number, last, filled = number + 1, place, 0
                filled += 1
                buckets.append(task << 32 | number)
                bodies.append(np.asarray(vectors[i].values, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(bodies, pa.binary()), pa.array(buckets, pa.int64()), batch.column(4)],
                [f.name for f in schema])

    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    keys = [*map(F.col, pure), F.col("_len").desc(), F.col("rid")]
    ordered = rows.withColumn("_len", length).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return common.materialise(ordered.select("rid", "_g", "_d", "vec", "anchor").mapInArrow(run, schema),
                              "buckets_by_" + "".join(pure))


def _cells(rows: DataFrame, asking: DataFrame, on: list[str], anchor_rows: int):
    """Every bucket with every block of the anchors that ``asking`` has for it
    (equal values in ``on``), grouped: rows have kind 0, anchors kind 1."""
    blocks = asking.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / anchor_rows).cast("int").alias("blocks"))
    pairs = rows.select(*on, "bucket").distinct().join(blocks, on).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    left = rows.join(pairs.select("bucket", "block"), "bucket").select(
        "bucket", "block", F.lit(0).alias("kind"), "rid", "_g", "body", F.lit(None).cast("array<long>").alias("bounds"))
    right = asking.join(blocks, on).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")).join(
        pairs, [*on, "block"]).select("bucket", "block", F.lit(1).alias("kind"), "rid", "_g", "body", "bounds")
    return left.unionByName(right).groupBy("bucket", "block")


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                   group_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
                   share: tuple[int, int] = LEAST_SHARE, scale: int = SCALE,
                   bucket_rows: int = BUCKET_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """For each anchor (rows where ``anchors`` is true) and each of its
    positives, the hard negatives: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Components become floor(scale * x); a score is the integer inner product
    with the anchor, higher ones first, ties by smaller id.  Positives are the
    first ``positives`` other rows of the anchor's label, negatives the first
    ``negatives`` rows of another label whose score s fits
    share[0] * p <= share[1] * s <= share[1] * p for the positive's score p.
    Defined cases: rows whose label or vector is null, or whose vector is empty
    or has a null or non-finite component, take no part, nor do those with a
    scaled component beyond sqrt(2^62 / components), whose scores might not fit
    64 bits (for 64 components: beyond 2^28); vectors of different lengths are
    not compared; a null id comes last in ties; repeated rows are rows of their
    own (a repeated anchor is an anchor each time, and its other copy a
    positive); an anchor without positives or a positive without negatives
    returns no row, and so does an empty table; other columns are not read.
    """
    rows = numbered(vectors.select(
        F.col(id_col).alias("_id"), F.col(group_col).alias("_g"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.col(vec_col).cast("array<double>").alias("vec")), "_id", "vectors")
    ids = rows.select("_rid", "_id")
    most = F.least(F.sqrt(F.lit(2.0 ** 62) / F.size("vec")), F.lit(2.0 ** 31 - 1))
    fits = finite("vec") & F.coalesce(~F.exists("vec", lambda x: F.abs(x) * scale >= most), F.lit(False))
    ready = rows.where(F.col("_g").isNotNull() & fits).select(
        F.col("_rid").alias("rid"), "_g", F.size("vec").alias("_d"),
        F.transform("vec", lambda x: F.floor(x * scale).cast("int")).alias("vec"), "anchor")

    by_label = _bucketed(ready, ["_g", "_d"], bucket_rows)
    asking = by_label.where("anchor").select("rid", "_g", "_d", "body", F.lit(None).cast("array<long>").alias("bounds"))
    near = _cells(by_label, asking, ["_g", "_d"], anchor_rows).applyInArrow(
        _near_rows(positives), "aid long, rid long, score long")
    order = Window.partitionBy("aid").orderBy(F.desc("score"), "rid")
    near = common.materialise(
        near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")

    bounds = near.groupBy("aid").agg(F.collect_set("score").alias("bounds"))      # at most ``positives`` a row
    asking = asking.drop("bounds").join(bounds, F.col("rid") == F.col("aid")).drop("aid")
    found = _cells(_bucketed(ready, ["_d"], bucket_rows), asking, ["_d"], anchor_rows).applyInArrow(
        _negative_rows(negatives, share), "aid long, bound long, rid long, score long")
    order = Window.partitionBy("aid", "bound").orderBy(F.desc("score"), "rid")
    found = common.materialise(
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives), "negatives")

    pairs = near.select("aid", F.col("rid").alias("pid"), F.col("score").alias("positive_score")).join(
        found.select(F.col("aid").alias("fid"), "bound", F.col("rid").alias("nid"), F.col("score").alias("negative_score"), "rank"),
        (F.col("aid") == F.col("fid")) & (F.col("positive_score") == F.col("bound")))
    for key, name in (("aid", "anchor_id"), ("pid", "positive_id"), ("nid", "negative_id")):
        pairs = pairs.join(ids.select(F.col("_rid").alias(f"_{key}"), F.col("_id").alias(name)), F.col(key) == F.col(f"_{key}"))
    return pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship_package(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH ready AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM ready a JOIN ready r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v)
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
