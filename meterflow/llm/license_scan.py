"""License scan by canonical digest lookup.

A text is brought to a canonical form (lower case, copyright lines dropped,
equivalent spellings made one, punctuation and white space as single spaces)
and the digest of the entire form is hash-joined to those of known licenses.
The same is done with every line and every paragraph of a text: a known
license of several lines or paragraphs is held where all its pieces follow
each other.  DataFrame functions only.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Equivalent spellings (from -> to), whole words of the lower-cased text.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "acknowledgement": "acknowledgment",
             "analogue": "analog", "favour": "favor", "organisation": "organization", "sub license": "sublicense",
             "noncommercial": "non commercial", "per cent": "percent", "copyright holder": "copyright owner"}

#: Known license notices: public texts, stated whole.  The full texts of
#: licenses are the files of ``licenses/`` (see ``known_licenses``).
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


#: What a line must hold to be one of ``_COPYRIGHT``.
_CLAIMS = ("copyright", "(c)", "©", "all rights reserved")
_COPYRIGHT = r"(?m)^[\s/*#;.-]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$"


def _spelled(out: Column) -> Column:
    for a, b in SPELLINGS.items():
        out = F.regexp_replace(out, rf"(?<![^ ]){a}(?![^ ])", b)
    return out


def _any_of(text: Column, words) -> Column:
    """Whether the text holds one of the words: plain searches, far cheaper than
    the expressions they stand before."""
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty."""
    out = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    out = F.regexp_replace(out, _COPYRIGHT, " ")
    return _spelled(F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")))


def known_licenses() -> list[tuple[str, str]]:
    """(name, text): the notices, and the full texts without title, version and
    copyright lines before them and without the appendix on how to apply them."""
    files = resources.files(__package__).joinpath("licenses").iterdir()
    full = [(f.name[:-4].removesuffix("-header"), f.read_text("utf-8")) for f in files if f.name.endswith(".txt")]
    return [*KNOWN, *sorted(full)]


def _base(lowered: Column) -> Column:
    """The canonical form before spelling, with the line ends kept, of a
    lower-cased text without copyright lines."""
    out = F.regexp_replace(lowered, r"[^\p{L}\p{N}\n]+", " ")
    return F.trim(F.regexp_replace(out, " ?\n ?", "\n"))


def _lowered(df: DataFrame, text: Column, *keep) -> DataFrame:
    """``keep`` and ``low``, the lower-cased text without copyright lines: a
    select a step, so that each is computed once."""
    low = df.select(*keep, F.lower(F.coalesce(text.cast("string"), F.lit(""))).alias("low"))
    names = [c for c in low.columns if c != "low"]
    return low.select(*names, F.when(_any_of(F.col("low"), _CLAIMS), F.regexp_replace("low", _COPYRIGHT, " "))
                      .otherwise(F.col("low")).alias("low"))


def _lines(base: Column) -> Column:
    return F.filter(F.split(base, "\n"), lambda x: x != "")


def _paragraphs(base: Column) -> Column:
    """Parted by lines without letters and digits."""
    return F.filter(F.transform(F.split(base, "\n\n+"), lambda x: F.trim(F.translate(x, "\n", " "))), lambda x: x != "")


def _digest(piece: str, other: Column | None = None) -> Column:
    """That of ``canonical`` for a piece of ``_base`` on one line; ``other``
    (false where the text has no other spelling) spares the search."""
    found = _any_of(F.col(piece), SPELLINGS)
    found = found if other is None else other & found
    return F.sha2(F.when(found, _spelled(F.col(piece))).otherwise(F.col(piece)), 256)


def _patterns(known: DataFrame) -> DataFrame:
    """(digest, i, k, pattern, name, size): piece ``i`` of the ``k`` that make
    a known license, whole, by paragraphs (as wrapped, and each on one line)
    and by lines."""
    unwrapped = F.regexp_replace("text", r"(?<=[^\s])[ \t]*\n[ \t]*(?=[^\s])", " ")
    low = _lowered(_lowered(known, F.col("text"), "name", unwrapped.alias("flat")).withColumnRenamed("low", "base"),
                   F.col("flat"), "name", "base")
    forms = low.select("name", _base(F.col("base")).alias("base"), _base(F.col("low")).alias("flat"))
    ways = [F.array(F.trim(F.regexp_replace("base", "\n+", " "))), _paragraphs(F.col("base")),
            _paragraphs(F.col("flat")), _lines(F.col("base"))]
    return (forms.where("base <> ''").select("name", F.explode(F.array(*ways)).alias("parts"))
            .select("name", F.size("parts").alias("k"), F.sha2(F.concat_ws("\n", "parts"), 256).alias("pattern"),
                    F.length(F.concat_ws(" ", "parts")).alias("size"), F.posexplode("parts").alias("i", "piece"))
            .select(_digest("piece").alias("digest"), "i", "k", "pattern", "name", "size").distinct())


def _held(docs: DataFrame, known: DataFrame, text_col: str) -> DataFrame:
    """(text digest, licenses, longest) of the texts that hold known licenses."""
    bases = _lowered(docs, F.col(text_col), F.sha2(common.text_of(text_col), 256).alias("th")).select(
        "th", _base(F.col("low")).alias("base"))
    bases = bases.select("th", "base", _any_of(F.translate("base", "\n", " "), SPELLINGS).alias("other"))
    numbered = lambda parts, kind: F.transform(parts, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("at"), x.alias("piece")))
    pieces = bases.select("th", "other", F.explode(F.concat(
        numbered(_lines(F.col("base")), 0), numbered(_paragraphs(F.col("base")), 1))).alias("p"))
    pieces = pieces.select("th", "other", "p.kind", "p.at", "p.piece").withColumn("digest", _digest("piece", F.col("other")))
    # the list of known licenses does not grow with the input: broadcast, no line is a hot key
    runs = pieces.join(F.broadcast(_patterns(known)), "digest").groupBy(
        "th", "kind", "pattern", "name", "k", "size", (F.col("at") - F.col("i")).alias("start")).agg(
        F.size(F.collect_set("i")).alias("found"))          # copies of a text meet here
    return runs.where("found = k").groupBy("th").agg(
        F.collect_set("name").alias("held"),
        F.min(F.struct((-F.col("size")).alias("s"), "name"))["name"].alias("longest"))


def license_scan(docs: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows with ``license`` (the known license whose canonical text equals
    the whole text's, else the longest that the text holds on lines or
    paragraphs of its own, else null), ``canonical_sha256`` and ``licenses``
    (names of all known licenses that the text is or holds, sorted), from
    known (name, text).

    Defined cases: null and empty texts, and those of copyright lines only,
    match no license; of two names with one canonical text the smaller is
    ``license``; a notice in the middle of a line is not held; repeated rows
    give a row each; an empty table gives an empty result; input columns named
    like a result column are replaced by it.
    """
    result = ("license", "canonical_sha256", "licenses")
    names = [c for c in docs.columns if c.lower() not in result]
    form = canonical(F.col("text"))
    digests = known.where(form != "").groupBy(F.sha2(form, 256).alias("_digest")).agg(F.min("name").alias("_whole"))
    low = _lowered(docs, F.col(text_col), F.struct(*common.without(docs, *result)).alias("_row"),
                   F.sha2(common.text_of(text_col), 256).alias("_th"))
    plain = low.select("_row", "_th", F.trim(F.regexp_replace("low", r"[^\p{L}\p{N}]+", " ")).alias("_plain"))
    rows = plain.select("_row", "_th", _digest("_plain").alias("canonical_sha256"))
    # the group side's key is an expression, so the skew join may split copies
    held = _held(docs, known, text_col).select(F.concat("th", F.lit("")).alias("_t"), "held", "longest")
    found = rows.join(digests, F.col("canonical_sha256") == F.col("_digest"), "left").join(
        held, F.col("_th") == F.col("_t"), "left")
    every = F.concat(F.coalesce("held", F.array().cast("array<string>")), F.array("_whole"))
    return found.select(*[F.col("_row")[c].alias(c) for c in names],
                        F.coalesce("_whole", "longest").alias("license"), "canonical_sha256",
                        F.array_sort(F.array_distinct(F.filter(every, lambda x: x.isNotNull()))).alias("licenses"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return license_scan(docs, spark.createDataFrame(known_licenses(), "name string, text string")).select(
        "doc_id", "license", "canonical_sha256", "licenses")
