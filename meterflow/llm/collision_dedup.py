"""Near-duplicate embeddings by collision-counting projections.

1. Equal vectors of one label form a class; only classes go on, so copies cost
   nothing further.
2. Classes are dealt into buckets: table ``t`` keys a class by the signs of
   ``bits`` random projections.  The tables are as many as bring two vectors at
   the threshold together at least once with the target recall; ``bits`` grows
   with the logarithm of the largest label, so buckets keep their size and the
   work stays near-linear.  A bucket larger than a block is split into blocks,
   and each pair of its blocks is one group: no bucket has a cap.
3. Within a group ``projections`` one-dimensional projections are sorted.  Each
   vector in turn is the query: its window holds the ranks whose projection
   lies within ``width`` of its own, and a pair collects one collision for each
   window that holds it.  Pairs with enough collisions - the count that a pair
   at the threshold reaches with the target recall - are verified by their
   cosine in double precision.
4. A pair counts in the first table that its vectors share, so no table of
   pairs is shuffled or made distinct: a group returns numbers of links and the
   edges of a spanning forest.  Components come from star steps over those.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .near_dedup import components
from .vectors import finite, matrix, numbered

COSINE = 0.98
#: Share of the pairs at the threshold that may be missed; closer pairs are
#: missed less often.  Half of it goes to the tables, half to the count.
MISS = 1e-6
BLOCK_ROWS = 1024
PROJECTIONS = 24
#: Half a window's width, in distances of a pair at the threshold.
WIDTH = 2.0
MOST_BITS = 30
SEED = 13


def tables_for(bits: int, cosine: float = COSINE, miss: float = MISS) -> int:
    """Tables after which two vectors at the threshold share no bucket with
    probability ``miss / 2`` at most: the signs of one projection agree with
    probability 1 - angle / pi."""
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if same >= 1 else math.ceil(math.log(miss / 2) / math.log(1 - same))


def least_collisions(projections: int = PROJECTIONS, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold stays below with
    probability ``miss / 2`` at most: its collisions are binomial."""
    inside, below = math.erf(WIDTH / math.sqrt(2)), 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * inside ** count * (1 - inside) ** (projections - count)
        if below > miss / 2:
            return count
    return projections


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)     # squares stay finite
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _coded(classes: DataFrame, bits: int, tables: int, dtype: str) -> DataFrame:
    """Classes with their vector as bytes and their bucket key in each table."""
    kind = classes.schema["_g"].dataType.simpleString()
    schema = common.schema_of(f"cid long, w long, _g {kind}, _d int, body binary, keys array<int>")

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits)
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                d = int(d)
                vectors = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d]).standard_normal((d, tables * bits))
                signs = (_unit(vectors) @ planes[d] > 0).reshape(len(vectors), tables, bits)
                keys = (signs @ powers).astype(np.int32).ravel()
                at = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * tables)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array([v.tobytes() for v in vectors.astype(dtype)], pa.binary()),
                     pa.ListArray.from_arrays(at, pa.array(keys))], [f.name for f in schema])

    return classes.mapInArrow(run, schema)


def _collisions(x: np.ndarray, y: np.ndarray, width: float) -> np.ndarray:
    """Collisions of each row of ``x`` with each of ``y``, a column a projection."""
    kind = np.uint16 if len(y) < 1 << 16 else np.uint32
    count = np.zeros((len(x), len(y)), np.uint8)
    rank = np.empty(len(y), kind)
    for i in range(x.shape[1]):
        order = np.argsort(y[:, i])
        line = y[order, i]
        rank[order] = np.arange(len(y), dtype=kind)
        first = np.searchsorted(line, x[:, i] - width, "left").astype(kind)
        past = np.searchsorted(line, x[:, i] + width, "right").astype(kind)
        count += (rank[None, :] - first[:, None]) < (past - first)[:, None]   # unsigned: below ``first`` wraps
    return count


def _forest(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Edges (id, least id of its tree) that span the links between ``rows`` and ``cols``."""
    edges, free_row, free_col = [], linked.any(axis=1), np.ones(len(cols), bool)
    for start in range(len(rows)):
        if not free_row[start]:
            continue
        front, tree = np.array([start]), []
        free_row[start] = False
        while len(front):
            tree.append(rows[front])
            reached = np.flatnonzero(linked[front].any(axis=0) & free_col)
            free_col[reached] = False
            tree.append(cols[reached])
            front = np.flatnonzero(linked[:, reached].any(axis=1) & free_row)
            free_row[front] = False
        ids = np.unique(np.concatenate(tree))
        edges += [(int(v), int(ids[0])) for v in ids[1:]]
    return edges


def _group_links(cosine: float, miss: float, projections: int, dtype: str):
    least, width = least_collisions(projections, miss), WIDTH * math.sqrt(2 - 2 * cosine)
    schema = pa.schema([("vid", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        none = pa.table({"vid": [], "links": [], "other": []}, schema=schema)
        cid, w = table["cid"].to_numpy(), table["w"].to_numpy().astype(np.float64)
        block, t = table["block"].to_numpy(), table["t"][0].as_py()
        a, b = np.flatnonzero(block == table["lo"][0].as_py()), np.flatnonzero(block == table["hi"][0].as_py())
        one = table["lo"][0].as_py() == table["hi"][0].as_py()
        if not len(a) or not len(b) or one and len(a) < 2:
            return none
        unit = _unit(matrix(table["body"], dtype))
        lines = unit @ np.random.default_rng([SEED, 1, unit.shape[1]]).standard_normal((unit.shape[1], projections))
        near = _collisions(lines[a], lines[b], width) >= least
        if one:
            near = np.triu(near, 1)
        a, b, near = a[i := near.any(axis=1)], b[j := near.any(axis=0)], near[i][:, j]
        if not near.size:
            return none
        near &= unit[a] @ unit[b].T >= cosine
        keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(cid), -1)
        for s in range(t):                       # the pair has counted in an earlier table
            near &= keys[a, s][:, None] != keys[b, s][None, :]
        links = np.zeros(len(cid))
        weight = near.astype(np.float64)
        np.add.at(links, a, weight @ w[b])
        np.add.at(links, b, w[a] @ weight)
        some = np.flatnonzero(links)
        edges = _forest(near, cid[a], cid[b])
        return pa.table({"vid": pa.array([*cid[some], *(v for v, _ in edges)], pa.int64()),
                         "links": pa.array([*links[some].astype(np.int64), *[0] * len(edges)], pa.int64()),
                         "other": pa.array([None] * len(some) + [o for _, o in edges], pa.int64())}, schema=schema)

    return run


def class_links(classes: DataFrame, dtype: str, cosine: float = COSINE, miss: float = MISS, bits: int | None = None,
                block_rows: int = BLOCK_ROWS, projections: int = PROJECTIONS) -> DataFrame:
    """classes (cid, w, _g, _d, vec) -> (vid, links, other): per group that a
    class is in, its numbers of linked vectors (other null), and forest edges."""
    if bits is None:                             # of one number per label, the largest
        most = classes.groupBy("_g", "_d").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(most, 1) / block_rows))))
    coded = common.materialise(_coded(classes, bits, tables_for(bits, cosine, miss), dtype), "coded")
    place = ["_g", "_d", "t", "key"]
    large = (coded.select("_g", "_d", F.posexplode("keys").alias("t", "key")).groupBy(*place)
             .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
             .select(*place, F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")))
    dealt = (coded.select("*", F.posexplode("keys").alias("t", "key")).join(large, place, "left")
             .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")
             # one column, so that the groups are dealt out anew: by the keys of the
             # join before, all pairs of blocks of a large bucket would stay together
             .withColumn("cell", F.struct(*place, "lo", "hi")))
    return common.materialise(
        dealt.groupBy("cell").applyInArrow(
            _group_links(cosine, miss, projections, dtype), "vid long, links long, other long"), "links")


def collision_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label",
                    cosine: float = COSINE, miss: float = MISS, bits: int | None = None,
                    block_rows: int = BLOCK_ROWS, projections: int = PROJECTIONS) -> DataFrame:
    """All rows of ``vectors`` with n_links (other rows linked directly),
    component_id (smallest id reachable by links) and kept (id = component_id).

    Rows are compared when their labels are equal and their vectors equally
    long, and linked from ``cosine`` on.  Defined cases: a null label, or a
    vector that is null, empty, zero or holds a null or non-finite component,
    links with nothing; repeated rows are rows of their own, linked with each
    other, and all that carry the component's id are kept; a null id counts as
    larger than all others, and a component of null ids alone has a null
    component_id and is kept; an empty table gives an empty result; input
    columns named like a result column are replaced by it.
    """
    taken = ("n_links", "component_id", "kept")
    named = [c for c in vectors.columns if c.lower() not in taken]
    rows = numbered(vectors.select(
        F.struct(*common.without(vectors, *taken)).alias("_row"), F.col(id_col).alias("_id"), F.col(group_col).alias("_g"),
        F.col(vec_col).alias("vec")), "_id", "vectors")
    element = rows.schema["vec"].dataType.elementType.typeName()
    dtype = "<f4" if element == "float" else "<f8"
    if element not in ("float", "double"):
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    usable = F.col("_g").isNotNull() & finite("vec") & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    ready = rows.where(usable).select("_rid", "_id", "_g", F.size("vec").alias("_d"), "vec")
    classes = common.materialise(
        ready.groupBy("_g", "_d", "vec").agg(F.min(F.struct("_rid", "_id")).alias("first"), F.count(F.lit(1)).alias("w"))
        .select(F.col("first._rid").alias("cid"), F.col("first._id").alias("first_id"), "w", "_g", "_d", "vec"), "classes")

    links = class_links(classes.select("cid", "w", "_g", "_d", "vec"), dtype, cosine, miss, bits, block_rows, projections)
    trees = components(links.where("other is not null").select(F.col("vid").alias("a"), F.col("other").alias("b")))
    linked = (links.groupBy("vid").agg(F.sum("links").alias("links")).join(trees, "vid", "left")
              .withColumn("comp", F.coalesce("comp", "vid"))
              .join(classes.select(F.col("cid").alias("comp"), F.col("first_id").alias("comp_id")), "comp")
              .select(F.col("vid").alias("_cid"), "links", "comp_id", F.lit(True).alias("_linked")))

    copies = classes.where("w > 1").select(F.xxhash64("_g", "vec").alias("_ch"), F.col("_g").alias("_cg"),
                                           F.col("vec").alias("_cvec"), "cid", "w", "first_id")
    own = rows.where(usable).withColumn("_h", F.xxhash64("_g", "vec"))
    own = (own.join(copies, (F.col("_h") == F.col("_ch")) & (F.col("_g") == F.col("_cg")) & (F.col("vec") == F.col("_cvec")), "left")
           .withColumn("_cid", F.coalesce("cid", "_rid")).select("_row", "_id", "_cid", "w", "cid", "first_id")
           .join(linked, "_cid", "left"))
    found = F.when(F.col("_linked"), F.col("comp_id")).when(F.col("cid").isNotNull(), F.col("first_id")).otherwise(F.col("_id"))
    own = own.select("_row", "_id", (F.coalesce("links", F.lit(0)) + F.coalesce("w", F.lit(1)) - 1).alias("n_links"),
                     found.alias("component_id"))
    rest = rows.where(~usable).select("_row", "_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return own.unionByName(rest).select(
        *[F.col("_row")[c].alias(c) for c in named], "n_links", "component_id",
        F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_collision_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship_package(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return collision_dedup(vectors).select("vec_id", "n_links", "component_id", "kept")


ORACLE = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT vec_id AS u, vec_id AS v FROM embeddings
  UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
numbers AS (SELECT u, count(*) AS n FROM links GROUP BY u),
least AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, e.vec_id = c AS kept
FROM embeddings e LEFT JOIN numbers m ON m.u = e.vec_id JOIN least s ON s.u = e.vec_id
"""
