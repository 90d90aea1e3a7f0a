"""URL filtering by rules and by empirical-Bayes host reputation.

A labelled page is an outcome: bad if its document is labelled as of low
quality or toxic.  Outcomes are counted by host, registered domain and suffix.  Each level's
bad share has a beta prior whose mean is the posterior mean of the level
above it (suffix under the whole table, domain under its suffix, host under
its domain) and whose strength is fitted to how far the groups of that level
scatter.  A page that no rule judges is blocked when the lower bound of its
host's posterior bad share is above the limit.

DataFrame functions only.  Pages are counted by host first, so a host with a
third of all pages is one row a task before any shuffle by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (verdict, rule): host and path prefix of a url, as the contract lists them.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
#: Suffixes of several labels under which sites are registered; others are the last label.
SUFFIXES = (*(f"{x}.uk" for x in ("co", "org", "ac", "gov", "ltd", "me", "net", "plc", "sch")),
            *(f"{x}.au" for x in ("com", "net", "org", "edu", "gov")), *(f"{x}.br" for x in ("com", "net", "org", "gov", "edu")),
            *(f"{x}.jp" for x in ("co", "ne", "or", "ac", "go")), *(f"{x}.nz" for x in ("co", "net", "org", "ac", "govt")),
            *(f"{x}.in" for x in ("co", "net", "org", "ac", "gov")), *(f"{x}.kr" for x in ("co", "or", "ac", "go")),
            *(f"{x}.za" for x in ("co", "org", "ac", "gov")), *(f"com.{x}" for x in ("ar", "cn", "mx", "tr", "tw", "sg", "hk")))
LIMIT = 0.5
Z = 1.645
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (by length of host and path together) that fits."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules=RULES) -> Column:
    return F.create_map(*[F.lit(x) for verdict, r in rules for x in (r, verdict)])[rule]


def site_of(host: Column) -> Column:
    """The host without its port."""
    return F.regexp_replace(host, ":[0-9]*$", "")


def _labels(site: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """Registered domain (one label more than the suffix) and suffix (the
    longest of ``suffixes`` that fits, else the last label); a numeric address
    is its own domain, all of them under one suffix."""
    domain, suffix = F.substring_index(site, ".", -2), F.substring_index(site, ".", -1)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        end = F.substring_index(site, ".", -n)
        fits = end.isin([s for s in suffixes if s.count(".") + 1 == n])
        domain = F.when(fits, F.substring_index(site, ".", -n - 1)).otherwise(domain)
        suffix = F.when(fits, end).otherwise(suffix)
    address = site.rlike(r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$")
    return F.when(address, site).otherwise(domain), F.when(address, F.lit("#")).otherwise(suffix)


def _strength(groups: DataFrame, *share: str) -> DataFrame:
    """One row, ``k``: the prior strength that the method of moments gives for
    groups (n, bad) around the mean ``prior``."""
    p = F.col("prior")
    return groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - p, 2)).alias("ss"),
        F.sum(p * (1 - p)).alias("pq"), F.sum(F.col("n") * p * (1 - p)).alias("npq"),
        ).select(F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), F.coalesce(
            # E[ss] = pq + (npq - pq) / (k + 1)
            F.when(F.col("ss") > F.col("pq"), (F.col("npq") - F.col("pq")) / (F.col("ss") - F.col("pq")) - 1),
            F.lit(MAX_STRENGTH)))).alias("k"))


def _shrunk(groups: DataFrame) -> DataFrame:
    """groups (.., n, bad, prior) with a, b of the beta posterior and its mean."""
    k = _strength(groups)
    return groups.crossJoin(F.broadcast(k)).select(     # k is a single row
        *groups.columns, (F.col("k") * F.col("prior") + F.col("bad")).alias("a"),
        (F.col("k") * (1 - F.col("prior")) + F.col("n") - F.col("bad")).alias("b")
        ).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def reputation(hosts: DataFrame, z: float = Z, suffixes=SUFFIXES) -> DataFrame:
    """(host, mean, lower, upper) from hosts (host, n, bad): the posterior
    bad share of each host without its port and its normal bounds at ``z``
    deviations."""
    domain, suffix = _labels(F.col("host"), suffixes)
    hosts = hosts.groupBy(site_of(F.col("host")).alias("host")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = common.materialise(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    total = F.sum("n").alias("n"), F.sum("bad").alias("bad")
    whole = hosts.agg(*total).select(((F.coalesce("bad", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)).alias("prior"))
    top = common.materialise(_shrunk(hosts.groupBy("suffix").agg(*total).crossJoin(F.broadcast(whole))), "suffixes")
    middle = hosts.groupBy("domain", "suffix").agg(*total).join(
        top.select("suffix", F.col("mean").alias("prior")), "suffix")
    middle = common.materialise(_shrunk(middle), "domains")
    low = common.materialise(_shrunk(hosts.join(middle.select("domain", F.col("mean").alias("prior")), "domain")), "posteriors")
    size = F.col("a") + F.col("b")
    spread = z * F.sqrt(F.col("a") * F.col("b") / (size * size * (size + 1)))
    return low.select("host", "mean", F.greatest(F.lit(0.0), F.col("mean") - spread).alias("lower"),
                      F.least(F.lit(1.0), F.col("mean") + spread).alias("upper"))


def outcomes(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """(host, n, bad) of all hosts: labelled pages and bad ones.  A url names
    its document by the first number of its path; a page without a labelled
    document counts as no outcome."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("_bad"))
    number = F.regexp_extract(path_of(F.col(url_col)), r"/([0-9]{1,18})(?![0-9])", 1)
    rows = pages.select(host_of(F.col(url_col)).alias("host"),
                        F.when(number != "", number.cast("long")).alias("_doc"))
    # pages of one host and document first become one row, so neither is a hot key
    rows = rows.groupBy("host", "_doc").agg(F.count(F.lit(1)).alias("_pages"))
    return rows.join(known, rows["_doc"] == known["doc_id"], "left").groupBy("host").agg(
        F.sum(F.when(F.col("_bad").isNotNull(), F.col("_pages")).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("_bad") == 1, F.col("_pages")).otherwise(0)).alias("bad"))


def judge(pages: DataFrame, hosts: DataFrame, url_col: str = "url", rules=RULES, limit: float = LIMIT,
          z: float = Z, suffixes=SUFFIXES) -> DataFrame:
    """All rows with host, path, rule, verdict and the host's ``reputation``
    (lower bound of its bad share) from hosts (host, n, bad).

    Defined cases: a null url, or one without ``://``, has an empty host and
    path and no rule; all empty hosts share one reputation; repeated rows get
    one verdict each; a host without outcomes has its domain's share; an empty
    table gives an empty result; input columns named like a result column are
    replaced by it.
    """
    result = ("host", "path", "rule", "verdict", "reputation")
    url = F.col(url_col)
    rows = pages.select(F.struct(*common.without(pages, *result)).alias("_row"),
                        host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    known = reputation(hosts, z, suffixes).select(F.concat("host", F.lit("")).alias("_host"), F.col("lower").alias("reputation"))
    own = F.when(F.col("reputation") > limit, "block").otherwise("allow")
    names = [c for c in pages.columns if c.lower() not in result]
    return rows.join(known, site_of(F.col("host")) == F.col("_host"), "left").select(
        *[F.col("_row")[c].alias(c) for c in names], "host", "path", "rule",
        F.coalesce(verdict_of(F.col("rule"), rules), own).alias("verdict"), "reputation")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship_package(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(pages, outcomes(pages, labels)).select("page_id", "host", "path", "rule", "verdict", "reputation")
