"""SpotSigs fingerprints with DataFrame functions only.

The common words of the corpus, those that most documents hold, are anchors.
Each anchor in a text starts a chain of the next CHAIN content words (words
that are no anchors); the hashed chains are the text's signatures and their
sorted set is its fingerprint.  Fingerprints are compared by Jaccard, which
set sizes bound: a pair whose smaller set is below the threshold's share of
the larger needs no comparison, so a join of similar documents partitions
them by set length and looks in the same and the next partition only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ANCHORS = 40
CHAIN = 2
RESULT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


#: Stands for a run of anchors in a text reduced to its words.
MARK = "\x01"


def spaced_words(text: Column) -> Column:
    """The lower-cased runs of letters, in order, one space before and after each."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"\P{L}++", " ")


def anchor_words(docs: DataFrame, text_col: str = "text", n: int = ANCHORS) -> list[str]:
    """The ``n`` words that most documents hold, ties by the word.  Documents
    count once a word, whatever their length; the list has a fixed bound."""
    plain = F.trim(spaced_words(common.text_of(text_col)))
    own = docs.select(F.explode(F.array_distinct(F.split(plain, " "))).alias("w")).where("w <> ''")
    top = own.groupBy("w").count().orderBy(F.desc("count"), "w").limit(n)
    return sorted(r["w"] for r in top.collect())


def with_signatures(rows: DataFrame, anchors: list[str], text: Column, name: str, chain: int = CHAIN) -> DataFrame:
    """``rows`` with ``name``: the sorted set of 32-bit chain hashes of a text.

    The text becomes its words joined by spaces and each run of anchors one
    mark (anchors of a run start the same chain); the ``chain`` content words
    after a mark, further marks left out, are hashed.  A chain that the
    text's end cuts short is left out.  A text without any chain has its words
    as signatures, so that short texts can be told apart.  Words and chains are
    columns of their own, so each is computed once.
    """
    plain, chains = F.col("_plain"), F.col("_chains")
    rows = rows.withColumn("_plain", spaced_words(text))
    marked = F.regexp_replace(plain, rf"(?: (?:{'|'.join(anchors)})(?= ))++", MARK) if anchors else plain
    content = rf" [^{MARK} ]++"
    rows = rows.withColumn("_chains", F.regexp_extract_all(
        marked, F.lit(rf"{MARK}(?=({(MARK + '?').join([content] * chain)}))"), F.lit(1)))
    found = F.transform(chains, lambda c: F.crc32(F.ltrim(F.replace(c, F.lit(MARK), F.lit(""))).cast("binary")))
    words = F.transform(F.split(F.trim(plain), " "), lambda w: F.crc32(w.cast("binary")))
    hashes = F.when(F.size(chains) > 0, found).when(plain == " ", F.array().cast("array<bigint>")).otherwise(words)
    return rows.withColumn(name, F.sort_array(F.array_distinct(hashes))).drop("_plain", "_chains")


def fingerprint(sigs: Column) -> Column:
    """The signatures as one string of eight hexadecimal digits each."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), " ")


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sorted sets; 0 without a look if their sizes show that it
    is below ``least``.  Two empty sets are alike (1)."""
    na, nb = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    value = F.when(F.greatest(na, nb) == 0, F.lit(1.0)).otherwise(both / (na + nb - both))
    return F.when(F.least(na, nb) < least * F.greatest(na, nb), F.lit(0.0)).otherwise(value)


def similar_documents(docs: DataFrame, anchors: list[str], least: float = 0.8, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(a, b, likeness) of the distinct fingerprints, named by their smallest
    id, with Jaccard at least ``least``.

    Equal fingerprints are one row before any pair is made.  Sets are
    partitioned by length, each partition ``least`` times as long as the next,
    so a partner is in the same partition or the next.  Within those, only
    sets that share one of the rarest signatures (the first
    n - ceil(least * n) + 1 in order of frequency) are compared.
    """
    sets = with_signatures(docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("t")),
                           anchors, F.col("t"), "s").select("id", "s")
    sets = sets.where((F.size("s") > 0) & F.col("id").isNotNull())
    sets = common.materialise(sets.groupBy("s").agg(F.min("id").alias("id")), "spot_sets")
    rows = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("sig"))
    often = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    order = Window.partitionBy("id").orderBy("often", "sig")         # one document's signatures
    shared = rows.join(often, "sig", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    prefix = (shared.withColumn("k", F.row_number().over(order))
              .where(F.col("k") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).where("often > 1"))
    prefix = prefix.withColumn("part", F.floor(F.log(F.col("n")) / -math.log(least)))
    left = prefix.select("sig", "part", F.col("id").alias("x"), F.col("n").alias("nx"))
    right = prefix.select("sig", F.explode(F.array("part", F.col("part") + 1, F.col("part") - 1)).alias("part"),
                          F.col("id").alias("y"), F.col("n").alias("ny"))
    pairs = (left.join(right, ["sig", "part"]).where("x < y")
             .where(F.least("nx", "ny") >= least * F.greatest("nx", "ny") - 1e-9)
             .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    one, two = (sets.select(F.col("id").alias(v), F.col("s").alias(f"s{v}")) for v in "ab")
    return (pairs.join(one, "a").join(two, "b")
            .select("a", "b", jaccard(F.col("sa"), F.col("sb"), least).alias("likeness"))
            .where(F.col("likeness") >= least - 1e-9))


def ranges(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (_id, _text) with ``_range``, a range of the id between sampled
    bounds, and ``_guest``: the first row of each range comes again as the
    guest at the end of the range before (the first range's: of the last).

    Null ids are a range of their own before the others; a range of one id
    splits no further.  Only ids are read to find the first rows.
    """
    bounds = docs.select(F.percentile_approx("_id", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]
    bounds = sorted(set(bounds or []))
    cut = F.array(*[F.lit(b) for b in bounds]).cast(f"array<{docs.schema['_id'].dataType.simpleString()}>")
    place = F.when(F.col("_id").isNull(), F.lit(-1)).otherwise(
        F.size(F.filter(cut, lambda b: b <= F.col("_id"))) if bounds else F.lit(0))
    rows = docs.withColumn("_range", place.cast("int"))
    first = rows.groupBy("_range").agg(F.min("_id").alias("_id")).orderBy("_range").collect()   # at most one a bucket
    if not first:
        return rows.withColumn("_guest", F.lit(False))
    names, ids = [r["_range"] for r in first], [r["_id"] for r in first if r["_id"] is not None]
    before = F.create_map(*[F.lit(x) for b, a in zip(names[-1:] + names[:-1], names) for x in (a, b)])
    guests = (rows.where(F.col("_id").isin(ids) | F.col("_id").isNull())
              .groupBy("_range", "_id").agg(F.min("_text").alias("_text"))
              .select("_id", "_text", before[F.col("_range")].alias("_range"), F.lit(True).alias("_guest")))
    return rows.withColumn("_guest", F.lit(False)).unionByName(guests)


def spot_fingerprints(docs: DataFrame, anchors: list[str], id_col: str = "doc_id",
                      text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """The id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next of every row.

    The edited text replaces the last floor(n_chars / 2) code points by the
    first as many of the next text.  Defined cases: a null text is empty; an
    empty text has the empty fingerprint and is like only another empty one;
    rows go in order of (id, text) with null ids first, so repeated rows follow
    each other; a table of one row is its own next; an empty table gives an
    empty result; other columns are left out.
    """
    buckets = buckets or common.shuffle_partitions(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("_id"), common.text_of(text_col).alias("_text"))
    # texts are shuffled once, and become signatures after the shuffle
    rows = with_signatures(ranges(base, buckets).repartition("_range"), anchors, F.col("_text"), "_own")
    order = Window.partitionBy("_range").orderBy("_guest", "_id", "_text")
    rows = rows.withColumn("_next", F.lead("_text").over(order)).withColumn("_after", F.lead("_own").over(order))
    rows = rows.where("not _guest")
    size = F.length("_text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), size - half), F.substring(F.col("_next"), F.lit(1), half))
    rows = rows.select("_id", size.cast("long").alias("n_chars"), edited.alias("_new"), "_own", "_after")
    rows = with_signatures(rows, anchors, F.col("_new"), "_edited").withColumn("edited_sha256", F.sha2("_new", 256))
    return rows.select(F.col("_id").alias(id_col), "n_chars", "edited_sha256",
                       fingerprint(F.col("_own")).alias("fingerprint"),
                       fingerprint(F.col("_edited")).alias("edited_fingerprint"),
                       jaccard(F.col("_own"), F.col("_edited")).alias("near_edited"),
                       jaccard(F.col("_own"), F.col("_after")).alias("near_next"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return spot_fingerprints(docs, anchor_words(docs))
