"""URL filters: ordered host/path rules, then trust and distrust along links.  DataFrame operations only.

Hosts that the rules allow are trusted seeds and hosts that they block are distrusted seeds, each with
the share of its pages so judged.  Trust follows links (personalised PageRank), distrust goes against
them: a host that links to a bad one is suspect.  A host whose distrust exceeds its trust by
``threshold`` is blocked for the urls that no rule judges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (Rule("allow", "org"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
#: The host of an absolute or scheme-relative link.
LINK = r"""(?i)href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\x20\x09-\x0D<>]+)"""
SALTS = 8


def _lower(c: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, nulls if none does."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return none if out is None else out.otherwise(none)


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst: distinct links between different hosts.  Only absolute and scheme-relative links name a host."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)))).alias("dst"))
    links = links.withColumn("dst", _lower(F.col("dst")))
    return links.where("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """seeds: host, trust, distrust.  Returns host, trust, distrust after ``rounds`` steps of
    rank = (1 - damping) * seed + damping * sum of the neighbours' rank / degree.

    Both directions go through one join a round.  Edges are dealt by (host, salt), so that the links of one
    host spread over SALTS tasks, and sums are combined before the shuffle.  A host that is repeated in seeds counts as often;
    null hosts and null or zero shares say nothing.  Repeated edges count as often.  Without edges every host keeps
    (1 - damping) of its seed; without seeds the result is empty.  Other columns of either are not read."""
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b")))
    salts = F.explode(F.array(*[F.lit(s) for s in range(SALTS)])).alias("salt")
    degree = both.groupBy("kind", "a").agg(F.count("*").alias("degree")).select("kind", "a", "degree", salts)
    both = common.written(both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(degree, ["kind", "a", "salt"]), "url-edges")
    start = seeds.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, seed)")).where("host is not null and seed > 0")
    start = start.groupBy("host", "kind").agg((F.sum("seed") * (1 - damping)).alias("seed"))
    rank = start.withColumnRenamed("seed", "rank")
    for k in range(rounds):
        sent = both.join(rank.select("kind", F.col("host").alias("a"), "rank", salts), ["kind", "a", "salt"])
        sent = sent.select("kind", F.col("b").alias("host"), (F.lit(damping) * F.col("rank") / F.col("degree")).alias("rank"))
        rank = sent.unionByName(start.select("kind", "host", F.col("seed").alias("rank"))).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if k % 3 == 2 or k == rounds - 1:
            rank = common.written(rank, "url-rank")
    kind = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k)
    return rank.groupBy("host").agg(kind("trust"), kind("distrust"))


def filter_urls(pages: DataFrame, rules=RULES, rounds: int = 10, damping: float = 0.85, threshold: float = 0.05) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of pages.

    A null url, or one without ``://``, has empty host and path, fits no rule and is allowed: nothing is
    known against it.  Null html has no links.  An unlinked host has trust and distrust from its own pages
    only.  Repeated rows are judged alike; an empty table gives an empty result; other columns are not read."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("r", rule_for(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"))
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    edges = common.written(host_edges(pages), "url-links")
    if edges.isEmpty():  # nothing to propagate: the first term of the rank is all of it
        ranks = seeds.select("host", *[(F.col(k) * (1 - damping)).alias(k) for k in ("trust", "distrust")])
    else:
        ranks = propagate(seeds, edges, rounds, damping)
    ranks = common.written(ranks.withColumnRenamed("host", "r_host"), "url-hosts")
    out = judged.join(ranks, judged["host"] == ranks["r_host"], "left").drop("r_host")
    out = out.withColumns({k: F.coalesce(F.col(k), F.lit(0.0)) for k in ("trust", "distrust")})
    by_host = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), "trust", "distrust")
