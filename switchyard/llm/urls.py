"""URL filtering: rules for hosts and paths, and a list of canonical URLs.

A URL that a rule fits gets that rule's verdict.  For the others the list
decides: a blocked Bloom filter over the listed canonical URLs (one 64-bit
word per block) passes possible hits on to an exact join with the list, which
removes the false positives.  The filter has at most ``MAX_BLOCKS`` words, so
broadcasting it is bounded however long the list grows; a longer list only
lets more false positives through to the join.

Everything is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Words of the Bloom filter at most (16 MB as a broadcast table of pairs), bits set per URL.
MAX_BLOCKS, PROBES = 1 << 20, 4
LISTED_PER_BLOCK = 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
#: Query parameters that do not name a page.
TRACKING = ("utm_[a-z]*", "ref", "fbclid", "gclid")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        """The rule's host or a subdomain of it, and a path that starts with the rule's."""
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (Rule(ALLOW, "org", "/"), Rule(BLOCK, "example.org", "/es/"), Rule(BLOCK, "example.org", "/en/1"),
         Rule(ALLOW, "com", "/fr/"), Rule(BLOCK, "com", "/de/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without a closing slash, and the
    query without tracking parameters; scheme and fragment go.  Null without a host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.concat(F.lit("&"), query), f"&({'|'.join(TRACKING)})=[^&]*", "")
    kept = F.regexp_replace(kept, "^&+", "")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null; of two as long the first in order of name."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    name = verdict = None
    for r in ordered:
        fit = r.fits(host, path)
        name = F.when(fit, r.name) if name is None else name.when(fit, r.name)
        verdict = F.when(fit, r.verdict) if verdict is None else verdict.when(fit, r.verdict)
    null = F.lit(None).cast("string")
    return (null, null) if name is None else (name, verdict)


def _probe(key: Column, blocks: int) -> tuple[Column, Column]:
    """(block, mask): the block of a URL and its bits there, from two hashes."""
    bits = F.xxhash64(F.lit(17), key)
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return F.pmod(F.xxhash64(key), F.lit(blocks)), mask


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, word) of the listed canonical URLs (column ``key``); absent blocks are empty."""
    block, mask = _probe(F.col("key"), blocks)
    return listed.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))


def blocks_for(n: int) -> int:
    blocks = 64
    while blocks * LISTED_PER_BLOCK < n and blocks < MAX_BLOCKS:
        blocks *= 2
    return blocks


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, blocks: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for every row of ``pages`` (page_id, url).

    ``listed`` has blocked canonical URLs in ``key``; nulls and repeats do not
    matter.  ``verdict`` is the fitting rule's, else block for a listed URL and
    allow for any other; ``listed`` tells whether the list was hit (null where
    a rule decided).  A null url has an empty host and path and is allowed.
    """
    listed = listed.select("key").where("key IS NOT NULL").distinct()
    blocks = blocks or blocks_for(listed.count())
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("key"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = parts.select("page_id", "host", "path", "key", rule.alias("rule"), verdict.alias("fixed"))
    block, mask = _probe(F.col("key"), blocks)
    open_ = ruled.select("*", F.when(F.col("fixed").isNull(), block).alias("block"), mask.alias("mask"))
    # bounded by MAX_BLOCKS rows of 16 bytes
    words = F.broadcast(bloom_filter(listed, blocks))
    probed = open_.join(words, "block", "left")
    possible = F.coalesce(F.col("fixed").isNull() & F.col("key").isNotNull() & (F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")), F.lit(False))
    out = ["page_id", "host", "path", "rule", "fixed", "hit"]
    sure = probed.where(~possible).select("page_id", "host", "path", "rule", "fixed", F.lit(False).alias("hit"))
    exact = listed.withColumn("hit", F.lit(True))
    checked = probed.where(possible).join(exact, "key", "left").select(*out[:-1], F.coalesce("hit", F.lit(False)).alias("hit"))
    return sure.unionByName(checked).select(
        "page_id", "host", "path", "rule",
        F.coalesce("fixed", F.when(F.col("hit"), BLOCK).otherwise(ALLOW)).alias("verdict"),
        F.when(F.col("fixed").isNull(), F.col("hit")).alias("listed"))
