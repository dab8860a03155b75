"""URL filters by hashed host-suffix and path-prefix expressions; DataFrame functions only.

Every distinct (host, leading part of the path) is expanded into all suffixes of its host times the path prefixes of the
lengths that rules have. Expressions meet rules by an equi-join on the first hex digits of their SHA-256; then the full
digests are compared, and the longest rule wins (ties: the longer host, then block before allow, then the smaller text).

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and takes the default verdict;
repeated rows and null ids stay as they are, one result for each input row; rules with a null part are ignored; an empty
page or rule table works; the pages' other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sha, small_side

#: Hex digits of the joined hash prefix (32 bits, as in public safe-browsing lists).
PREFIX_HEX = 8
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_digests(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict) with their text, digest and hash prefix; one row for each text (block wins)."""
    known = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    digest = sha(F.concat("host", F.lit("\n"), "path"))
    return known.select(
        F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_len"), F.length("path").alias("path_len"),
        digest.alias("digest"), F.substring(digest, 1, PREFIX_HEX).alias("hash_prefix"))


def expressions(sites: DataFrame, lengths: list[int]) -> DataFrame:
    """(host, lead, digest, hash_prefix) for every host suffix and every path prefix of the given lengths."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = sites.select("host", "lead", F.explode(suffixes).alias("suffix"))
    wide = wide.select("host", "lead", "suffix", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("n")).where(F.length("lead") >= F.col("n"))
    digest = sha(F.concat("suffix", F.lit("\n"), F.expr("substring(lead, 1, n)")))
    return wide.select("host", "lead", digest.alias("digest")).withColumn("hash_prefix", F.substring("digest", 1, PREFIX_HEX))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """(id, host, path, rule, verdict, matched) for every row of pages."""
    digests = rule_digests(rules)
    # The distinct lengths of rule paths bound the expansion; they are a handful of numbers, not the rules.
    lengths = sorted(r[0] for r in digests.select("path_len").distinct().collect())
    base = pages.select(F.col(f"`{id_col}`").alias("__id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    lead = F.substring("path", 1, max(lengths, default=0))
    base = base.withColumn("lead", lead)
    sites = base.select("host", "lead").distinct()
    hits = expressions(sites, lengths).alias("e").join(small_side(digests).alias("r"), "hash_prefix")
    hits = hits.where(F.col("e.digest") == F.col("r.digest"))
    rank = F.struct(F.length("rule").alias("n"), F.col("host_len"), (F.col("verdict") == "block").alias("b"), F.col("rule"))
    best = hits.groupBy("host", "lead").agg(F.max(F.struct(rank.alias("rank"), F.col("rule"), F.col("verdict"))).alias("best"), F.count(F.lit(1)).alias("matched"))
    out = base.join(best, ["host", "lead"], "left")
    return out.select(
        F.col("__id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"), F.coalesce("matched", F.lit(0)).cast("long").alias("matched"))
