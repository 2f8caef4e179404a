"""URL filters: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

Every listed URL sets one bit in each of the 8 longs of a single block. The filter is a table of blocks made by bitwise or (one row per
block); it has about 12 bits for each listed URL but never more than MAX_BLOCKS blocks (4 MB), so it may be broadcast whatever the list.
A longer list only lets more URLs pass to the exact join, which decides alone: no listed URL is missed, no other is taken.

Null URLs and those without `://` have empty host and path; no rule fits them and no list has them. Rows are kept one for one, null and
repeated keys too. An empty list blocks nothing. Only key and URL are read, so other columns cannot clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGS = 8
MAX_BLOCKS = 1 << 16


def host(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, A-Z lowered."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(h: Column, p: Column) -> Column:
    """Host without a leading www. or m., path without a closing .html and slashes; scheme, query and fragment do not count. Null without a host."""
    return F.when(h != "", F.concat(F.regexp_replace(h, r"^(www|m)\.", ""), F.regexp_replace(F.regexp_replace(p, r"\.html$", ""), r"/+$", "")))


def split(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    out = pages.select(F.col(key).alias("key"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    return out.withColumn("canon", canonical(F.col("host"), F.col("path")))


def rule_columns(rules: list[tuple[str, str]], h: Column, p: Column) -> tuple[Column, Column]:
    """(verdict, "host/path") rules: the longest that fits, and its verdict. A rule fits its host, all subdomains, and paths that start with its own."""
    rule = verdict = F.lit(None).cast("string")
    for what, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, start = name.partition("/")
        fits = ((h == own) | F.endswith(h, F.lit("." + own))) & F.startswith(p, F.lit(slash + start if start else "")) & (p.startswith("/") if not start else F.lit(True))
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def _bits(url: Column) -> list[Column]:
    """One bit in each long: six bits of a second hash name it."""
    h = F.xxhash64(F.lit(1), url)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(LONGS)]


def bloom(listed: DataFrame, url: str = "canon") -> tuple[DataFrame, int]:
    """block, w0 .. w7 of a table of distinct URLs."""
    n = listed.count()
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * 64 * LONGS < 12 * n:
        blocks *= 2
    rows = listed.select(_block(F.col(url), blocks).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(_bits(F.col(url)))])
    return rows.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(LONGS)]), blocks


def possible(urls: DataFrame, filter_table: DataFrame, blocks: int, url: str = "canon") -> DataFrame:
    """Adds possible: false only for URLs that are certainly not listed. The filter has at most MAX_BLOCKS rows."""
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.col(url))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) == b)
    joined = urls.join(F.broadcast(filter_table), _block(F.coalesce(F.col(url), F.lit("")), blocks) == F.col("block"), "left")
    return joined.select(*urls.columns, F.coalesce(hit & F.col(url).isNotNull(), F.lit(False)).alias("possible"))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, listed (boolean), verdict. listed: a table with the column canon."""
    listed = checkpoint(listed.select("canon").filter(F.col("canon").isNotNull()).distinct())
    table, blocks = bloom(listed)
    urls = possible(split(pages, key, url), checkpoint(table), blocks)
    exact = listed.select(F.col("canon").alias("on_list"))
    yes = urls.filter("possible").join(exact, F.col("canon") == F.col("on_list"), "left").withColumn("listed", F.col("on_list").isNotNull()).drop("on_list")
    every = yes.unionByName(urls.filter("not possible").withColumn("listed", F.lit(False)))
    rule, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    return every.select(F.col("key").alias(key), "host", "path", rule.alias("rule"), "listed", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def listed_by_terms(pages: DataFrame, terms: tuple[str, ...], key: str = "page_id", url: str = "url") -> DataFrame:
    """canon of all pages whose host has one of the terms as a word of a label."""
    return split(pages, key, url).filter(F.col("host").rlike(r"(^|[.-])(" + "|".join(terms) + r")([.-]|$)")).select("canon")
