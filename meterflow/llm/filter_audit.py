"""Filter interaction audit by joins of failing-id relations.

One id table is stored per filter: the documents that fail it, with their part
and label marks (a left-semi join of the documents with the failing ids).  The
audit then walks over the filters once.  Its state holds, per filter ``f`` and
set ``mask`` of filters applied before it, the documents that fail ``f`` and
have survived ``mask``; each step adds the next filter ``g`` to every mask:

* a left-anti join with the ids of ``g`` leaves what ``f`` removes after
  ``mask`` and ``g`` too;
* a left-semi join gives what became redundant for ``f`` by ``g``.

What a prefix of an order removes depends on the set of its filters alone, so
all n! orders read their figures from the n * 2^(n-1) counts of these states.
Only failing documents are joined, on an id that each table holds once.
"""

from __future__ import annotations

import hashlib
import itertools
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: With more filters the orders (n!) outgrow a table that anyone reads.
MOST_FILTERS = 7
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _steps(names: list[str]) -> Column:
    """Every order of the filters, a row a step: (filter_order, step, f, mask)."""
    at = {name: i for i, name in enumerate(names)}
    rows = [{"filter_order": "".join(order), "step": k + 1, "f": at[name], "mask": sum(1 << at[x] for x in order[:k])}
            for order in itertools.permutations(names) for k, name in enumerate(order)]
    return F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,f:int,mask:int>>"))


def _chains(n: int) -> Column:
    """Every filter and set of others: (f, mask, chain), chain the states in
    which the members of ``mask`` were added, in the order of the steps."""
    rows = []
    for f in range(n):
        for mask in range(1 << n):
            if not mask >> f & 1:
                rows.append({"f": f, "mask": mask, "chain": [mask & ((2 << g) - 1) for g in range(n) if mask >> g & 1]})
    return F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<f:int,mask:int,chain:array<int>>>"))


def filter_audit(rows: DataFrame, fails: dict[str, DataFrame], key: str = "_rid") -> DataFrame:
    """One row per part, order of the filters and step of it, with the figures
    of that step's filter after the filters before it.

    ``rows``: (key, part, good, toxic), each non-null key once; ``fails``: by
    filter name the keys of the documents that fail it, each once.  The result
    has part, filter_order (the names joined), step (from 1) and FIGURES; steps
    that remove nothing are there with zeros.  A null part counts as the empty
    string, null marks as false; no rows give an empty result; keys in ``fails``
    that ``rows`` lacks count for nothing.
    """
    names = list(fails)
    n, full = len(names), (1 << len(names)) - 1
    if not 1 <= n <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters can be audited, not {n}")
    rows = rows.select(F.col(key).alias("_k"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"),
                       F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    relations = [common.materialise(rows.join(fails[name].select(F.col(key).alias("_k")), "_k", "left_semi"), f"fails_{i}")
                 for i, name in enumerate(names)]

    state = None
    for f, relation in enumerate(relations):
        own = relation.withColumns({"f": F.lit(f), "mask": F.lit(0)})
        state = own if state is None else state.unionByName(own)
    hits = None
    for g, relation in enumerate(relations):
        others = state.where(F.col("f") != g).withColumn("mask", F.col("mask").bitwiseOR(F.lit(1 << g)))
        ids = relation.select("_k")
        hit = others.join(ids, "_k", "left_semi").groupBy("part", "f", "mask").agg(F.count(F.lit(1)).alias("again"))
        hits = hit if hits is None else hits.unionByName(hit)
        state = common.materialise(state.unionByName(others.join(ids, "_k", "left_anti")), f"states_{g}")

    counts = state.groupBy("part", "f", "mask").agg(
        F.count(F.lit(1)).alias("removed"), F.count_if("good").alias("good_lost"), F.count_if("toxic").alias("toxic_lost"))
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    combos = totals.select("part", _chains(n).alias("c")).select("part", "c.*")
    again = (combos.select("part", "f", F.col("mask").alias("_mask"), F.explode("chain").alias("mask"))
             .join(hits, ["part", "f", "mask"]).groupBy("part", "f", "_mask").agg(F.sum("again").alias("redundant"))
             .withColumnRenamed("_mask", "mask"))
    zero = {c: 0 for c in ("removed", "good_lost", "toxic_lost", "redundant")}
    facts = (combos.drop("chain").join(counts, ["part", "f", "mask"], "left").join(again, ["part", "f", "mask"], "left")
             .fillna(zero)
             .withColumn("unique_fails", F.max(F.when(F.col("mask") == F.expr(f"{full} - shiftleft(1, f)"), F.col("removed")))
                         .over(Window.partitionBy("part", "f"))))
    steps = totals.select("part", "_n", _steps(names).alias("s")).select("part", "_n", "s.*")
    done = Window.partitionBy("part", "filter_order").orderBy("step")
    return steps.join(facts, ["part", "f", "mask"]).select(
        "part", "filter_order", "step",
        (F.col("_n") - F.sum("removed").over(done)).alias("kept"), "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "f")).alias("shapley"))


# --- the five text filters --------------------------------------------------------------------

#: Fixed values of the filters' conditions.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SYMBOLS = 200, 50, 3, b"#$%&*|"
_UPPER = bytes(range(65, 91))


def text_failures(text: str) -> int:
    """Bits 0 to 3: whether the text fails A (too few words), B (too few
    distinct words), C (too many capitals), D (holds a symbol)."""
    raw = text.encode()
    words = raw.split()                       # bytes part at 09-0D and 20, at nothing else
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return ((len(words) < LEAST_WORDS)
            | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
            | (100 * upper > MOST_UPPER * len(text)) << 2
            | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3)


def _measured(base: DataFrame) -> DataFrame:
    """The rows with failures and digest, each text read once and dropped."""
    kind = base.schema["_id"].dataType.simpleString()
    schema = common.schema_of(f"_rid long, _id {kind}, part string, bits int, digest binary")

    def run(batches):
        for batch in batches:
            bits, digests = [], []
            for text in batch.column(3):
                text = text.as_py()
                bits.append(text_failures(text))
                digests.append(hashlib.sha256(text.encode()).digest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], [f.name for f in schema])

    return common.materialise(base.mapInArrow(run, schema), "measured")


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    part_col: str = "lang") -> DataFrame:
    """``filter_audit`` of the five filters A to E over ``docs``.

    E fails a text that a row with a smaller id has too, wherever that row
    stands and whether or not another filter removes it.  Texts are equal when
    length and SHA-256 are.  Defined cases: a null text is the empty text (it
    fails A); a null part is the empty string; a row without id is never the
    smaller one and never fails E; repeated rows (same id) count each, and none
    of them is a copy of the other; labels may repeat, then one that says so is
    enough; an empty table gives an empty result; other columns are not read.
    """
    base = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(id_col).alias("_id"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       common.text_of(text_col).alias("text"))
    measured = _measured(base)
    marks = labels.groupBy(F.col("doc_id").alias("_lid")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = common.materialise(
        measured.join(marks, measured["_id"] == marks["_lid"], "left").drop("_lid"), "audited")

    # the copies' join key goes through an expression, so that both sides are
    # shuffles of their own and a hot text's rows can be split
    firsts = (rows.groupBy("digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
              .select(F.xxhash64("digest").alias("_h"), F.col("digest").alias("_d"), "_first"))
    copies = rows.select("_rid", "_id", "digest", F.xxhash64("digest").alias("_h")).join(firsts, "_h").where(
        "digest = _d and _id > _first").select("_rid")
    fails = {name: rows.where(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0).select("_rid") for i, name in enumerate("ABCD")}
    return filter_audit(rows.select("_rid", "part", "good", "toxic"), fails | {"E": copies})


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH measured AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         [w FOR w IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS words
  FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                 max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT m.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(words) < 200,
          100 * len(list_distinct(words)) < 50 * len(words),
          100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
          regexp_matches(t, '[#$%&*|]'),
          coalesce(m.doc_id > min(m.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM measured m LEFT JOIN marks k ON m.doc_id = k.doc_id),
classes AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
parts AS (SELECT part, sum(n) AS n FROM classes GROUP BY part),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.c <> a.c AND c.c NOT IN (a.c, b.c) AND d.c NOT IN (a.c, b.c, c.c) AND e.c NOT IN (a.c, b.c, c.c, d.c)),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f
          FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
hit AS (
  SELECT s.filter_order, s.step, s.f, c.part, c.n, c.good, c.toxic,
         c.fails[ascii(s.f) - 64] AS own,
         len([i FOR i IN [1, 2, 3, 4, 5] IF i < s.step AND c.fails[ascii(substr(s.filter_order, i, 1)) - 64]]) AS earlier,
         len([i FOR i IN [1, 2, 3, 4, 5] IF c.fails[i]]) AS all_fails
  FROM steps s, classes c),
figures AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN own AND earlier = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN own AND earlier > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN own AND all_fails = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN own AND earlier = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN own AND earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM hit GROUP BY part, filter_order, step, f)
SELECT g.part, filter_order, step,
       CAST(p.n - sum(removed) OVER (PARTITION BY g.part, filter_order ORDER BY step) AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY g.part, f) AS BIGINT) AS shapley
FROM figures g JOIN parts p ON g.part = p.part
"""
