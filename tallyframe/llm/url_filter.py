"""URL filtering: host and path rules, then a blocked Bloom filter of listed canonical URLs and an exact join.

DataFrame functions only. The filter is a table of (block, word) rows: a listed URL sets `probes` bits in the one 64-bit
word its hash names, `bit_or` combines the words. The number of blocks follows from the size of the list, about four URLs a
block, so the filter stays selective as the list grows. A filter of at most `broadcast_blocks` blocks (16 bytes each) is broadcast, a larger one meets the
pages in a join of two shuffled sides. URLs whose bits are all set go on to a hash join with the list itself,
which removes the false positives; while the filter is broadcast, all other URLs are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (host, path, verdict), fixed values of the job.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; null, or without "://": both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Canonical URL: no scheme, query, fragment or leading "www."; trailing slashes and ".html" dropped."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(\.html|/+)$", ""))


def matched_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    rule = verdict = F.lit(None).cast("string")
    for h, p, what in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _bits(key: Column, probes: int) -> tuple[Column, Column]:
    """(hash for the block, word with the key's bits set)."""
    h = F.xxhash64(F.lit(7), key)
    word = F.lit(0).cast("bigint")
    for i in range(probes):
        word = word.bitwiseOR(_bit(h, i))
    return F.xxhash64(F.lit(11), key), word


def _bit(h: Column, i: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int"))


def blocks_for(keys: int, per_block: int = 4) -> int:
    """Blocks of a filter for so many keys: a power of two, so that each block's word holds about per_block of them."""
    return 1 << max(6, (max(keys, 1) // per_block).bit_length())


def bloom_table(listed: DataFrame, blocks: int = 65_536, probes: int = 5) -> DataFrame:
    """(block, word) of the listed keys (column `canonical`); null keys set nothing."""
    block, word = _bits(F.col("canonical"), probes)
    return (
        listed.where(F.col("canonical").isNotNull())
        .select(F.pmod(block, F.lit(blocks)).cast("int").alias("block"), word.alias("bits"))
        .groupBy("block")
        .agg(F.bit_or("bits").alias("word"))
    )


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules=RULES, blocks: int | None = None, probes: int = 5, listed_verdict: str = "block", broadcast_blocks: int = 1 << 21
) -> DataFrame:
    """Judges each row of pages (page_id, url) by rule, else by the list (canonical), which is written to the shared folder once.

    Returns page_id, host, path, rule, verdict, canonical, maybe_listed, listed. Null URLs and URLs without "://" have an empty
    host and path, fit no rule whose host is not empty, and are canonical "". Repeated rows stay repeated. An empty list blocks nothing. Columns
    of pages other than page_id and url are not looked at, whatever their names.
    """
    other = "allow" if listed_verdict == "block" else "block"
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"), canonical(F.col("host"), F.col("path")).alias("canonical"))
    keys = cut(listed.select("canonical").where(F.col("canonical").isNotNull()).distinct(), "listed")
    blocks = blocks or blocks_for(keys.count())
    block, word = _bits(F.col("canonical"), probes)
    rows = rows.select("*", F.pmod(block, F.lit(blocks)).cast("int").alias("block"), word.alias("bits"))
    bloom = bloom_table(keys, blocks, probes)
    probed = rows.join(F.broadcast(bloom) if blocks <= broadcast_blocks else bloom, "block", "left").select(
        "page_id", "host", "path", "rule", "by_rule", "canonical", F.coalesce(F.col("word").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False)).alias("maybe_listed")
    )
    sure = probed.where(~F.col("maybe_listed")).withColumn("listed", F.lit(False))
    hits = probed.where("maybe_listed").join(keys.select("canonical", F.lit(True).alias("listed")).hint("shuffle_hash"), "canonical", "left")
    hits = hits.withColumn("listed", F.coalesce("listed", F.lit(False)))
    return sure.unionByName(hits).select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("listed"), F.lit(listed_verdict)).otherwise(F.lit(other))).alias("verdict"),
        "canonical", "maybe_listed", "listed",
    )


def stand_in_list(pages: DataFrame) -> DataFrame:
    """A stand-in for an outside block list: canonical URLs under example.org whose article number ends in 0."""
    host, path = split_url(F.col("url"))
    c = pages.select(canonical(host, path).alias("canonical"))
    return c.where(F.col("canonical").rlike(r"(^|\.)example\.org/.*0$")).distinct()


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the four fixed rules, then the stand-in list."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, stand_in_list(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


ORACLE = r"""
WITH r AS (
  SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), t AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '(\.html|/+)$', '') AS canonical,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM s
)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block'
    ELSE CASE WHEN regexp_matches(canonical, '(^|\.)example\.org/.*0$') THEN 'block' ELSE 'allow' END END AS verdict,
  regexp_matches(canonical, '(^|\.)example\.org/.*0$') AS listed
FROM t
"""
