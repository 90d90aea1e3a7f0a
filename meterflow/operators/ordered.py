"""Skew-safe ordered row frames per key.

Per-machine lags, rolling statistics and 24-step sequences are row-count
frames over a machine's readings in time order.  ``Window.partitionBy(key)``
alone sends every reading of a machine to one task, so a machine holding a
third of all rows would become a single straggler task.

``ordered_frames`` avoids that:

1. A narrow aggregate finds *hot* keys (more than ``chunk_rows`` rows).  Only
   those are listed on the driver; there are at most ``rows / chunk_rows`` of
   them, so the list and its broadcast have a proven bound.
2. Each hot key is cut into chunks of at most ``chunk_rows`` rows at quantiles
   of its order, from a mergeable sketch; an instant that holds many of its
   rows is cut again at quantiles of the tie-break.  Every other key is one
   chunk.
3. One window pass over ``(key, chunk)`` computes the caller's frame columns
   and the position inside the chunk.  Per-chunk counts (a small aggregate)
   turn that into the position within the key (``_ord``).
4. Rows within ``halo`` positions of a chunk seam saw a cut frame.  They are
   recomputed from the *seam set* -- the rows within ``2*halo`` of a seam --
   which holds every row those frames need, and replace the chunk-pass rows.

Frames used by ``build`` must lie inside ``[-halo, +halo]`` rows.  When no key
is hot the plan is the plain single window (one shuffle).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.constants import WINDOW

ORD = "_ord"   # 0-based position of the row within its key, in order
CNT = "_cnt"   # number of rows of the key

DEFAULT_CHUNK_ROWS = 2_000_000
#: Cut points per ``chunk_rows`` rows.  A chunk holds the rows between two cuts
#: (n / cuts), those of the instant it starts with (under two cuts, or that
#: instant is cut by itself) and the sketch's error: three quarters of a chunk.
OVERSPLIT = 4
#: Rank error of the sketch, in shares of the rows between two cuts.
SKETCH_ERROR = 1 / 16
MAX_DEPTH = 3        # seam-set recursion levels before a plain per-key window
CHUNK_CONF = "meterflow.chunkRows"
#: Up to so many cut points (16 bytes each) the plan table is broadcast.
BROADCAST_CUTS = 1_000_000

Builder = Callable[[WindowSpec], dict[str, Column]]
Cut = tuple[float, float]


def chunk_rows_of(df: DataFrame, chunk_rows: int | None = None) -> int:
    if chunk_rows is not None:
        return int(chunk_rows)
    value = df.sparkSession.conf.get(CHUNK_CONF, None)
    return int(value) if value else DEFAULT_CHUNK_ROWS


def _order_value(df: DataFrame, name: str) -> Column:
    """Numeric image of an order column, monotone in it; null, which sorts
    first, is below all others."""
    dtype = df.schema[name].dataType
    col = F.col(name)
    if isinstance(dtype, T.TimestampNTZType):
        image = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    elif isinstance(dtype, T.TimestampType):
        image = F.unix_micros(col)
    elif isinstance(dtype, T.DateType):
        image = F.unix_date(col)
    elif isinstance(dtype, T.StringType):            # by the first six bytes
        image = F.conv(F.rpad(F.hex(F.substring(F.encode(col, "UTF-8"), 1, 6)), 12, "0"), 16, 10)
    else:
        image = col
    return F.coalesce(image.cast("double"), F.lit(float("-inf")))


def _images(df: DataFrame, order: Sequence[str]) -> tuple[Column, Column]:
    """Images of the leading order column and of the tie-break after it."""
    order = list(order)
    return _order_value(df, order[0]), _order_value(df, order[1]) if len(order) > 1 else F.lit(0.0)


# Hot-key lists per (input plan and files, key, order, chunk size) within a
# session.  The chunk plan only balances work -- every chunking gives the same
# rows -- so reusing a list for a semantically identical input is safe.
_HOT_CACHE: dict[tuple, list] = {}
_HOT_CACHE_MAX = 256


def _hot_keys(df: DataFrame, key: str, order: Sequence[str], chunk_rows: int) -> list[dict]:
    try:
        cache_key = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), hash(tuple(sorted(df.inputFiles()))),
                     key, tuple(order), chunk_rows)
    except Exception:  # plans without a semantic hash
        cache_key = None
    if cache_key is not None and cache_key in _HOT_CACHE:
        return _HOT_CACHE[cache_key]
    rows = _hot_keys_scan(df, key, order, chunk_rows)
    if cache_key is not None:
        if len(_HOT_CACHE) >= _HOT_CACHE_MAX:
            _HOT_CACHE.clear()
        _HOT_CACHE[cache_key] = rows
    return rows


def _cuts_for(rows: int, chunk_rows: int) -> int:
    return max(1, math.ceil(OVERSPLIT * rows / chunk_rows)) - 1


def _quantiles(value: str, cuts: int) -> Column:
    """``cuts`` evenly spaced quantiles from Spark's mergeable sketch."""
    return F.percentile_approx(value, [(i + 1) / (cuts + 1) for i in range(cuts)],
                               max(10_000, math.ceil((cuts + 1) / SKETCH_ERROR)))


def _hot_keys_scan(df: DataFrame, key: str, order: Sequence[str], chunk_rows: int) -> list[dict]:
    """Keys with more than ``chunk_rows`` rows and their cut points.  At most
    rows / chunk_rows keys pass, with OVERSPLIT cuts a chunk: a bounded list."""
    v, u = _images(df, order)
    hot = [r.asDict() for r in df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
           .filter(F.col("n") > chunk_rows).collect()]
    if not hot:
        return []
    most = max(_cuts_for(r["n"], chunk_rows) for r in hot)
    spark = df.sparkSession
    # a null key's readings stay one group, as without chunks
    listed = [r for r in hot if r["k"] is not None]
    if not listed:
        return []
    keys = spark.createDataFrame([(r["k"],) for r in listed], T.StructType([T.StructField("_hk", df.schema[key].dataType)]))
    rows = df.select(F.col(key).alias("_k"), v.alias("_v"), u.alias("_u")).join(F.broadcast(keys), F.col("_k") == F.col("_hk"))
    times = {r["_k"]: r["q"] for r in rows.groupBy("_k").agg(_quantiles("_v", most).alias("q")).collect()}

    cuts: dict = {}
    heavy = []                                       # instants that hold two cuts and more
    for r in listed:
        own, found = _cuts_for(r["n"], chunk_rows), times[r["k"]]
        # the smaller of two hot keys takes evenly spaced ones of the quantiles
        taken = [found[(i + 1) * (most + 1) // (own + 1) - 1] for i in range(own)]
        cuts[r["k"]] = {(t, float("-inf")) for t in taken}
        heavy += [(r["k"], t, n) for t, n in Counter(taken).items() if n > 1]
    if heavy and len(list(order)) > 1:
        schema = T.StructType([T.StructField("_hk", df.schema[key].dataType), T.StructField("_hv", T.DoubleType())])
        instants = spark.createDataFrame([h[:2] for h in heavy], schema)
        inside = rows.drop("_hk").join(F.broadcast(instants), (F.col("_k") == F.col("_hk")) & (F.col("_v") == F.col("_hv")))
        most = max(2 * n for _, _, n in heavy)
        for r in inside.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("n"), _quantiles("_u", most).alias("q")).collect():
            own = min(most, _cuts_for(r["n"], chunk_rows))
            cuts[r["_k"]] |= {(r["_v"], r["q"][(i + 1) * (most + 1) // (own + 1) - 1]) for i in range(own)}
            cuts[r["_k"]].add((r["_v"], float("inf")))
    return [{"key": r["k"], "n": r["n"], "cuts": sorted(cuts[r["k"]])} for r in listed]


def _assign_chunks(df: DataFrame, key: str, v: Column, u: Column, hot: list[dict]) -> DataFrame:
    """Add ``_chunk``: the number of the key's cut points up to the row, 0 for
    other keys.  The cuts lie in blocks of about the root of their number, so a
    row is compared with one block's cuts and the blocks' first ones."""
    point = "struct<v:double,u:double>"
    plan_rows = []
    for r in hot:
        step = max(1, math.isqrt(len(r["cuts"])))
        blocks = [r["cuts"][i:i + step] for i in range(0, len(r["cuts"]), step)]
        plan_rows.append((r["key"], step, [b[0] for b in blocks], blocks))
    schema = T.StructType([T.StructField("_pk", df.schema[key].dataType), T.StructField("_step", T.IntegerType()),
                           T.StructField("_heads", T._parse_datatype_string(f"array<{point}>")),
                           T.StructField("_blocks", T._parse_datatype_string(f"array<array<{point}>>"))])
    plan = df.sparkSession.createDataFrame(plan_rows, schema)
    if sum(len(r["cuts"]) for r in hot) <= BROADCAST_CUTS:
        plan = F.broadcast(plan)
    at = F.struct(F.col("_v").alias("v"), F.col("_u").alias("u"))
    block = F.col("_block")
    return (
        df.withColumns({"_v": v, "_u": u}).join(plan, F.col(key) == F.col("_pk"), "left")
        .withColumn("_block", F.size(F.filter("_heads", lambda c: c <= at)))
        .withColumn("_chunk", F.when(F.col("_pk").isNull() | (block == 0), F.lit(0)).otherwise(
            (block - 1) * F.col("_step") + F.size(F.filter(F.get("_blocks", block - 1), lambda c: c <= at))))
        .drop("_v", "_u", "_pk", "_step", "_heads", "_blocks", "_block")
    )


def chunk_plan(df: DataFrame, key: str, order: Sequence[str],
               chunk_rows: int | None = None) -> DataFrame:
    """Diagnostics: ``df`` with the ``_chunk`` each row is processed in."""
    chunk_rows = chunk_rows_of(df, chunk_rows)
    return _assign_chunks(df, key, *_images(df, order), _hot_keys(df, key, order, chunk_rows))


def ordered_frames(df: DataFrame, key: str, order: Sequence[str],
                   build: Builder | None = None, halo: int = WINDOW,
                   chunk_rows: int | None = None, _hot: list | None = None,
                   _depth: int = 0, _by: str | None = None) -> DataFrame:
    """Add ``_ord``, ``_cnt`` and the columns of ``build(window)`` to ``df``.

    ``build`` receives a window spec ordered by ``order`` and returns named
    columns whose frames stay within ``halo`` rows of the current row.

    The seam set of a hot key is itself ordered per key, so it is processed
    by the same function: a key whose seam set may exceed ``chunk_rows`` is
    chunked again by the number of the seam (a chunk has at most ``4 * halo``
    seam rows, so that plan needs no statistics job), up to ``MAX_DEPTH``
    levels.  Each level shrinks a key's rows by about
    ``chunk_rows / (4 * OVERSPLIT * halo)``.
    """
    order = list(order)
    build = build or (lambda w: {})
    chunk_rows = chunk_rows_of(df, chunk_rows)
    hot = _hot if _hot is not None else _hot_keys(df, key, order, chunk_rows)

    if not hot:
        w = Window.partitionBy(key).orderBy(*order)
        out = df.withColumn(ORD, (F.row_number().over(w) - 1).cast("long"))
        cols = build(w)
        if cols:
            out = out.withColumns(cols)
        return out.withColumn(CNT, F.count(F.lit(1)).over(Window.partitionBy(key)))

    v, u = _images(df, order) if _by is None else (F.col(_by).cast("double"), F.lit(0.0))
    chunked = _assign_chunks(df, key, v, u, hot)
    if _by is not None:
        chunked = chunked.drop(_by)

    # Per-chunk counts give each chunk's offset within its key.  Plain
    # equality keeps the join partitioned on (key, chunk), which the window
    # below reuses; null keys find no match and are one chunk of their own.
    kw = Window.partitionBy("_k")
    counts = (
        chunked.groupBy(F.col(key).alias("_k"), F.col("_chunk").alias("_kc"))
        .agg(F.count(F.lit(1)).alias("_kcc"))
        .select(
            "_k", "_kc",
            F.coalesce(F.sum("_kcc").over(kw.orderBy("_kc").rowsBetween(
                Window.unboundedPreceding, -1)), F.lit(0)).alias("_koff"),
            F.sum("_kcc").over(kw).alias("_kn"),
            (F.col("_kc") == F.min("_kc").over(kw)).alias("_kfirst"),
            (F.col("_kc") == F.max("_kc").over(kw)).alias("_klast"),
        )
    )
    joined = chunked.join(
        counts, (F.col(key) == F.col("_k")) & (F.col("_chunk") == F.col("_kc")), "left"
    )

    wc = Window.partitionBy(key, "_chunk").orderBy(*order)
    pass1 = (
        joined.withColumn("_pos", F.row_number().over(wc) - 1)
        .withColumn("_cc", F.count(F.lit(1)).over(Window.partitionBy(key, "_chunk")))
        .withColumn("_off", F.coalesce(F.col("_koff"), F.lit(0)))
        .withColumn("_first", F.coalesce(F.col("_kfirst"), F.lit(True)))
        .withColumn("_last", F.coalesce(F.col("_klast"), F.lit(True)))
        .withColumn(CNT, F.coalesce(F.col("_kn"), F.col("_cc")))
        .drop("_k", "_kc", "_koff", "_kn", "_kfirst", "_klast")
    )
    cols = build(wc)
    if cols:
        pass1 = pass1.withColumns(cols)
    pass1 = pass1.withColumn(ORD, (F.col("_off") + F.col("_pos")).cast("long"))

    pos, cc = F.col("_pos"), F.col("_cc")
    first, last = F.col("_first"), F.col("_last")
    needs_fix = (~first & (pos < halo)) | (~last & (pos >= cc - halo))
    in_seam = (~first & (pos < 2 * halo)) | (~last & (pos >= cc - 2 * halo))

    helper = ["_chunk", "_off", "_cc", "_first", "_last", "_pos"]
    if not cols or halo <= 0:
        return pass1.drop(*helper)
    keep = pass1.filter(~needs_fix)
    hot_list = [r["key"] for r in hot]
    fix_col = f"_fix{_depth}"
    seam_no = f"_seam{_depth}"
    seam_in = (pass1.filter(F.col(key).isin(hot_list)).filter(in_seam)
               .withColumn(fix_col, needs_fix).withColumn(seam_no, F.col("_chunk")).drop(*cols.keys()).drop(*helper)
               .withColumnRenamed(ORD, f"_gord{_depth}").withColumnRenamed(CNT, f"_gcnt{_depth}"))
    # Next level: keys whose seam set can exceed chunk_rows, cut between seams
    nxt = []
    if _depth + 1 < MAX_DEPTH:
        for r in hot:
            chunks = len(r["cuts"]) + 1
            parts = min(chunks, _cuts_for(4 * halo * chunks, chunk_rows) + 1)
            if 4 * halo * chunks > chunk_rows and parts > 1:
                nxt.append({"key": r["key"], "n": 4 * halo * chunks,
                            "cuts": sorted({(float(i * chunks // parts), float("-inf")) for i in range(1, parts)})})
    seam = ordered_frames(seam_in, key, [f"_gord{_depth}"], build, halo, chunk_rows,
                          _hot=nxt, _depth=_depth + 1, _by=seam_no)
    seam = (seam.drop(ORD, CNT, seam_no).withColumnRenamed(f"_gord{_depth}", ORD)
            .withColumnRenamed(f"_gcnt{_depth}", CNT).filter(F.col(fix_col)).drop(fix_col))
    return keep.drop(*helper).unionByName(seam)


def with_ordinal(df: DataFrame, key: str, order: Sequence[str],
                 chunk_rows: int | None = None) -> DataFrame:
    """Position of each row within its key (``_ord``) and key size (``_cnt``)."""
    return ordered_frames(df, key, order, None, halo=0, chunk_rows=chunk_rows)
