"""URL filters: a blocked Bloom filter before an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import lower_ascii

#: Bits of a block: one long word, so a probe reads one word.
BLOCK_BITS = 64


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or no ``://``."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, probes: int) -> Column:
    """The bits that a key sets in its block."""
    bits = [F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`, {k + 101}), {BLOCK_BITS}) AS INT))") for k in range(probes)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


#: The filter goes to every task as one array, so it has at most so many bits (64 MB); a longer list has fewer bits a key.
MOST_BITS = 1 << 29


def bloom_filter(keys: DataFrame, expected: int, bits_per_key: int = 16, probes: int = 4) -> tuple[DataFrame, int]:
    """(one row with the array ``words`` of a blocked Bloom filter of the column ``key``, number of blocks).

    Words are made by a grouped OR of the keys' masks; the array is bounded by ``MOST_BITS``, however many keys there are.
    """
    blocks = max(1, min(-(-expected * bits_per_key // BLOCK_BITS), MOST_BITS // BLOCK_BITS))
    made = keys.where("key IS NOT NULL").select(_block(F.col("key"), blocks).alias("block"), _mask("key", probes).alias("mask"))
    words = made.groupBy("block").agg(F.bit_or("mask").alias("word"))
    every = keys.sparkSession.range(blocks).join(words, F.col("id") == F.col("block"), "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0)).alias("word"))))["word"].alias("words")), blocks


def _may_hold(words: Column, key: Column, blocks: int, probes: int) -> Column:
    """Whether the filter may hold a key: all its bits are set in its block."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(k + 101)), F.lit(BLOCK_BITS)).cast("int")) for k in range(probes)]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return F.get(F.transform(F.array(mask), lambda m: F.get(words, _block(key, blocks).cast("int")).bitwiseAND(m) == m), F.lit(0))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow", bits_per_key: int = 16, probes: int = 4, broadcast_rows: int = 200_000) -> DataFrame:
    """Judge every row's url by the listed prefixes: id, host, path, rule, verdict, bloom_hits.

    ``rules`` has host, path and verdict. A rule's canonical key is host and path put together. It fits
    its host and all subdomains, where the url's path starts with the rule's; of those that fit,
    the longest key wins, then the longer host, then block over allow.

    A url's candidate keys are the suffixes of its host at dots, each with the prefixes of its
    path of the lengths that the list has. They are asked of the Bloom filter within their row, which every task holds as one array
    of bounded size. A url none of whose candidates pass is judged there, without a shuffle; only what passes becomes rows, and an exact join on the key
    removes what isn't listed. The list is broadcast up to ``broadcast_rows`` rows; beyond, the passed candidates are shuffled to it.

    Null urls and urls without ``://`` have an empty host and path and no rule; very long urls are read whole. Repeated rows each have a row
    in the result; an empty list or table is fine. Other columns (and their names) don't matter.
    """
    listed = rules.select(lower_ascii(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.lower("verdict").alias("rule_verdict")).where("rule_host IS NOT NULL AND rule_host != ''")
    listed = listed.withColumn("key", F.concat("rule_host", "rule_path"))
    size = listed.agg(F.count("*").alias("n"), F.coalesce(F.sort_array(F.collect_set(F.length("rule_path"))), F.array()).alias("lengths")).first()
    hint = F.broadcast if size["n"] <= broadcast_rows else (lambda df: df)
    words, blocks = bloom_filter(listed.select("key"), size["n"], bits_per_key, probes)

    parts = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    labels = F.split("host", r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    lengths = F.filter(F.array(*[F.lit(n) for n in size["lengths"]]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(lengths, lambda n: F.struct(F.concat(h, F.substring(F.col("path"), F.lit(1), n)).alias("key"), h.alias("rule_host")))))
    asked = parts.join(F.broadcast(words)).withColumn("hits", F.filter(keys, lambda c: _may_hold(F.col("words"), c["key"], blocks, probes)))  # one row of words
    asked = asked.select("id", "host", "path", "hits", F.size("hits").cast("long").alias("bloom_hits"))
    none = F.lit(None).cast("string")
    clear = asked.where("bloom_hits = 0").select(F.col("id").alias(id_col), "host", "path", none.alias("rule"), F.lit(otherwise).alias("verdict"), "bloom_hits")

    hit = asked.where("bloom_hits > 0").withColumn("row", F.monotonically_increasing_id())
    order = F.struct(F.length("key").alias("n"), F.length("rule_host").alias("h"), (F.col("rule_verdict") == "block").alias("b"), F.col("key").alias("rule"), F.col("rule_verdict").alias("verdict"))
    tried = hit.select("row", "id", "host", "path", "bloom_hits", F.inline("hits")).join(hint(listed), ["key", "rule_host"], "left")
    judged = tried.groupBy("row", "id", "host", "path", "bloom_hits").agg(F.max(F.when(F.col("rule_verdict").isNotNull(), order)).alias("best"))
    found = judged.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"), "bloom_hits")
    return clear.unionByName(found)
