"""URL verdicts: prefix rules, then a blocked Bloom filter and an exact join, native operations only.

A listed URL is known by its canonical form. The filter has blocks of 256 bits; a URL picks one
block and eight bits in it, so a probe is one equi-join row and a few bit operations. Possible hits,
and only those, go to the exact hash join with the list, which removes false positives.

The longest rule that fits decides; else a listed URL is blocked and any other allowed.

Defined results: a null URL, or one without ``://``, has empty host and path and is never listed;
rows that repeat are judged alike; other columns are ignored; an empty table gives no rows, an empty
list blocks nothing.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropwind.sources.paths import written

#: (verdict, host, path) of the query's rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BITS_PER_URL = 16
BLOCK_BITS = 256
BLOCK_BYTES = 48
#: A filter up to this size is sent to every executor; a larger one is joined by block.
BROADCAST_BYTES = 8 << 20


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` and default port, path without its last slash or ``.html``; null if there is no host."""
    name = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    return F.when(host != "", F.concat(name, F.regexp_replace(path, r"(/|\.html?)$", "")))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else null."""
    rule = verdict = F.lit(None).cast("string")
    for action, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _masks(url: Column) -> list[Column]:
    """Four words with two bits each, from six bits of a second hash for each bit."""
    h = F.xxhash64(url, F.lit(1))
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(8)]
    return [bit[i].bitwiseOR(bit[i + 4]) for i in range(4)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """``block, w0..w3`` of the used blocks."""
    masks = _masks(F.col("url"))
    return listed.select(_block(F.col("url"), blocks).alias("block"), *(m.alias(f"m{i}") for i, m in enumerate(masks))).groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(4)))


def probed(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """``urls`` (with a column ``url``) and ``possible``: whether the filter of the distinct list passes the URL."""
    blocks = max(1, math.ceil(listed.count() * BITS_PER_URL / BLOCK_BITS))
    table = bloom(listed, blocks)
    if blocks * BLOCK_BYTES <= BROADCAST_BYTES:
        table = F.broadcast(table)
    # Rows without a URL are dealt over all blocks, as none of them can be listed.
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(blocks))
    block = F.when(F.col("url").isNull(), spread).otherwise(_block(F.col("url"), blocks))
    found = urls.withColumn("block", block).join(table, "block", "left")
    possible = F.col("url").isNotNull()
    for i, mask in enumerate(_masks(F.col("url"))):
        possible &= F.coalesce(F.col(f"w{i}").bitwiseAND(mask) == mask, F.lit(False))
    return found.withColumn("possible", possible).drop("block", "w0", "w1", "w2", "w3")


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page; ``listed`` has canonical URLs in ``url``."""
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    # A rule's verdict needs no probe.
    url = F.when(F.col("verdict").isNull(), canonical(F.col("host"), F.col("path")))
    parts = parts.select("*", rule.alias("rule"), verdict.alias("verdict")).withColumn("url", url)
    listed = written(listed.select("url").where("url IS NOT NULL").distinct(), "url-list")
    # Written, so that pages are read and probed once for both branches.
    rows = written(probed(parts, listed), "url-probed")
    exact = listed.withColumn("hit", F.lit("block"))
    maybe = rows.where("possible").join(exact, "url", "left")
    out = [F.col(c) for c in ("page_id", "host", "path", "rule")]
    judged = maybe.select(*out, F.coalesce("hit", F.lit("allow")).alias("verdict"))
    return judged.unionByName(rows.where("NOT possible").select(*out, F.coalesce("verdict", F.lit("allow")).alias("verdict")))


def listed_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Canonical URLs of pages whose document, numbered in the path, is labelled toxic or of low quality."""
    bad = labels.where("toxic = 1 OR quality = 0").select(F.col("doc_id").alias("number"))
    number = F.regexp_extract(path(F.col("url")), r"/(\d{1,18})(?:/|\.html?)?$", 1)
    urls = pages.select(number.try_cast("long").alias("number"), canonical(host(F.col("url")), path(F.col("url"))).alias("url"))
    return urls.join(bad, "number", "left_semi").select("url")


SQL = r"""
WITH numbered AS (
  SELECT page_id, url, row_number() OVER () AS row_no FROM pages
), parts AS (
  SELECT row_no, page_id, url,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM numbered
), known AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '(/|\.html?)$', '') END AS canonical,
         try_cast(regexp_extract(path, '/(\d{1,18})(/|\.html?)?$', 1) AS BIGINT) AS number
  FROM parts
), listed AS (
  SELECT DISTINCT canonical FROM known
  WHERE canonical IS NOT NULL AND number IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)
), rules(action, name, start) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT k.*, r.name || r.start AS rule, r.action,
         row_number() OVER (PARTITION BY k.row_no ORDER BY length(r.name || r.start) DESC) AS place
  FROM known k LEFT JOIN rules r ON (k.host = r.name OR ends_with(k.host, '.' || r.name)) AND starts_with(k.path, r.start)
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM fits WHERE place = 1
"""
