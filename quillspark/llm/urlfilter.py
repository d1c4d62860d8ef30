"""URL filters: host and path rules, then a blocked Bloom filter in front of an exact hash join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import spare_names

#: At most this many rules: they are compiled into one expression.
MAX_RULES = 1000
#: The filter is sent to every executor, so its size has a bound whatever the list's length; a longer list only lets
#: more false hits through to the exact join. A block is one row of a key and eight 64-bit words.
MAX_BLOCKS = 1 << 15
BITS_PER_URL = 12
PROBES = 4


def lower_ascii(c) -> F.Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(c) -> F.Column:
    """Between the first :// and the next /, ?, # or end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(c, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(c) -> F.Column:
    return F.coalesce(F.regexp_extract(c, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(c) -> F.Column:
    """Host without a leading www. and path without .html or trailing slashes; scheme, query and fragment go."""
    host, path = F.regexp_replace(url_host(c), r"^www\.", ""), F.regexp_replace(F.rtrim(url_path(c), F.lit("/")), r"\.html$", "")
    return F.concat(host, path)


def rule_of(host, path, rules: list[tuple[str, str]]) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits, null where none does.

    A rule `host/path` fits its host and every subdomain where the url's path starts with the rule's. Equally long
    rules: the one with the longer host.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0].index("/"))):
        h, p = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def bloom_blocks(urls: DataFrame, url: str, n_blocks: int) -> DataFrame:
    """(block, w0..w7): the blocked Bloom filter of the distinct urls; each url sets PROBES bits within one block."""
    bits = _bits(F.col(url), n_blocks)
    word = lambda i: F.bit_or(F.when(F.shiftright("bit", 6) == i, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63))).otherwise(F.lit(0).cast("long"))).alias(f"w{i}")
    return urls.select(bits.alias("x")).select("x.block", F.explode("x.bits").alias("bit")).groupBy("block").agg(*[word(i) for i in range(8)])


def _bits(url, n_blocks: int) -> F.Column:
    h, g = F.xxhash64(url, F.lit(1)), F.xxhash64(url, F.lit(2))
    at = [F.shiftrightunsigned(g, 9 * i).bitwiseAND(511).cast("int") for i in range(PROBES)]
    return F.struct(F.pmod(h, F.lit(n_blocks)).cast("int").alias("block"), F.array(*at).alias("bits"))


def listed_urls(pages: DataFrame, listed: DataFrame, url: str = "canonical", list_url: str = "canonical") -> DataFrame:
    """pages with the boolean column `listed`: is its canonical url in the list?

    The Bloom filter, of bounded size, is broadcast; only the urls it lets through go to the exact join, which removes
    its false hits. Null urls are not listed, nor do null list entries list anything; repeated pages and entries are
    judged each by its own url; an empty list lists nothing.
    """
    block, x, hit = spare_names(pages, "bloom_block", "bloom_x", "listed")
    if hit != "listed":
        raise ValueError("the input has a column named listed already")
    names = listed.select(F.col(list_url).alias("url")).where("url is not null").distinct()
    n = min(MAX_BLOCKS, max(1, names.count() * BITS_PER_URL // 512 + 1))
    blocks = bloom_blocks(names, "url", n).select(F.col("block").alias(block), F.array(*[f"w{i}" for i in range(8)]).alias("bloom_words"))
    probed = pages.withColumn(x, _bits(F.col(url), n)).withColumn(block, F.col(f"{x}.block")).join(F.broadcast(blocks), block, "left")
    bit = lambda i: F.call_function("shiftrightunsigned", F.element_at("bloom_words", F.shiftright(F.col(f"{x}.bits")[i], 6) + 1), F.col(f"{x}.bits")[i].bitwiseAND(63)).bitwiseAND(1) == 1
    may = F.col("bloom_words").isNotNull() & F.col(url).isNotNull()
    for i in range(PROBES):
        may = may & F.coalesce(bit(i), F.lit(False))
    probed = probed.withColumn("bloom_may", may)
    keep = pages.columns
    sure = names.withColumn("listed", F.lit(True)).hint("shuffle_hash")
    hits = probed.where("bloom_may").select(*keep).join(sure.withColumnRenamed("url", "bloom_url"), F.col(url) == F.col("bloom_url"), "left")
    hits = hits.select(*keep, F.coalesce("listed", F.lit(False)).alias("listed"))
    return probed.where("not bloom_may").select(*keep, F.lit(False).alias("listed")).unionByName(hits)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, url: str = "url", list_url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict (allow or block).

    The longest rule that fits decides. Where none fits, a page is blocked if its canonical url is one of the listed
    ones, else allowed. Null urls and such without :// have an empty host and path, fit no rule and are allowed.
    Columns of pages named host, path, rule, verdict, canonical or listed are replaced; other extra columns stay.
    """
    mine = ["host", "path", "rule", "verdict", "canonical", "listed"]
    base = pages.drop(*[c for c in mine if c != url])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    web = F.contains(F.col(url), F.lit("://"))
    judged = base.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))}).withColumns({"rule": rule, "verdict": verdict, "canonical": F.when(web, canonical_url(F.col(url)))})
    names = listed.where(F.contains(F.col(list_url), F.lit("://"))).select(canonical_url(F.col(list_url)).alias("canonical"))
    out = listed_urls(judged, names)
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow"))).drop("canonical", "listed")
