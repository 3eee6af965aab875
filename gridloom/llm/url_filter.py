"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join that removes false positives.

Rules and listed URLs are canonical strings "host/path". A rule holds for its host and all subdomains where the url's
path starts with the rule's. For each url, every pair of a host suffix and a path prefix of a length that occurs in the
list is a possible entry. All pairs are probed in a blocked Bloom filter (one 64-bit word for each block, four bits for
each entry, at least 16 bits an entry); pairs that pass go to an exact join with the list; the longest entry wins.
Everything is DataFrame functions. The filter has a fixed number of blocks for a list of given length. Where it fits the bound
of a broadcast, it is one array of words and each url is probed in place, so urls without a possible hit (null ones too)
are never shuffled; a larger one is joined by block. Distinct sites with possible hits meet the list once.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path: from there up to "?", "#" or the end.
Null urls and urls without "://" have both empty, fit no rule, and are allowed. Of rules of equal length, the one that
sorts last wins (a block before an allow of the same entry). Rows that repeat each return a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.util import BROADCAST_BYTES, materialize, small

#: The query's rules: entry and verdict.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.when(url.contains("://"), F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), *_LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _bits(entry: str) -> str:
    """A word with the entry's four bits set."""
    return " | ".join(f"shiftleft(1L, cast(shiftright(xxhash64({entry}, 1), {s}) & 63 as int))" for s in (0, 6, 12, 18))


def blocked_bloom(entries: DataFrame, blocks: int) -> DataFrame:
    """(block, word): the filter of the column entry, its empty blocks left out."""
    return entries.select(F.expr(f"pmod(xxhash64(entry), {blocks})").alias("block"), F.expr(_bits("entry")).alias("bit")).groupBy("block").agg(F.bit_or("bit").alias("word"))


def _words(bloom: DataFrame, blocks: int) -> DataFrame:
    """One row: the filter's words in the order of their blocks, 0 where a block is empty."""
    every = bloom.sparkSession.range(blocks).withColumnRenamed("id", "block").join(bloom, "block", "left")
    return every.groupBy().agg(F.sort_array(F.collect_list(F.struct("block", F.coalesce("word", F.lit(0).cast("long")).alias("word")))).alias("w")).select(F.expr("transform(w, x -> x.word)").alias("words"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "entry string, verdict string")


def url_filter(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule (the entry that decided, or null), verdict, for each page.

    rules: entry ("host/path", the path with its slash), verdict; may be a long list of blocked URLs.
    """
    rules = rules.where("entry is not null and instr(entry, '/') > 0").groupBy("entry").agg(F.max("verdict").alias("verdict"))
    n, lengths = rules.agg(F.count("*"), F.collect_set(F.expr("length(substring(entry, instr(entry, '/')))"))).first()
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    if not n:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.expr(f"transform(filter(array({', '.join(map(str, sorted(lengths)))}), n -> length(path) >= n), n -> substring(path, 1, n))")
    blocks = 1 << max(4, math.ceil(math.log2(max(n, 1) * 16 / 64)))
    tried = urls.withColumns({"suffixes": suffixes, "prefixes": prefixes}).withColumn("entries", F.expr("if(host = '' or path = '', cast(array() as array<string>), flatten(transform(suffixes, s -> transform(prefixes, p -> concat(s, p)))))")).drop("suffixes", "prefixes")
    bits = f"({_bits('e')})"
    if blocks * 8 <= BROADCAST_BYTES:
        # the whole filter is one array of words: each url is probed in place, and only possible hits go on
        words = F.broadcast(_words(blocked_bloom(rules, blocks), blocks))
        probed = tried.crossJoin(words).withColumn("entries", F.expr(f"filter(entries, e -> (get(words, cast(pmod(xxhash64(e), {blocks}) as int)) & {bits}) = {bits})")).drop("words")
        possible = probed.where("size(entries) > 0").select("host", "path", "entries").distinct().select("host", "path", F.explode("entries").alias("entry"))
    else:
        probed = tried
        sites = tried.where("size(entries) > 0").select("host", "path", "entries").distinct().select("host", "path", F.explode("entries").alias("e"))
        met = sites.withColumn("block", F.expr(f"pmod(xxhash64(e), {blocks})")).join(blocked_bloom(rules, blocks), "block")
        possible = met.where(f"(word & {bits}) = {bits}").select("host", "path", F.col("e").alias("entry"))
    hits = possible.join(small(rules, n, 256), "entry")
    best = materialize(hits.groupBy("host", "path").agg(F.max(F.struct(F.length("entry").alias("n"), F.col("entry"), F.col("verdict"))).alias("best")), "hits")
    miss = probed.where("size(entries) = 0").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    judged = probed.where("size(entries) > 0").join(small(best, best.count(), 512), ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("best.entry").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict")).union(miss)
