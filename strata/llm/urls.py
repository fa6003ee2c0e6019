"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

Listed keys are rules (host and path prefix) and canonical URLs. Each sets its bits within one block of 512 bits, so
a test touches one cache line. A URL's candidate keys are its host's suffixes and its path's prefixes of the
lengths that occur in the rules, and its own canonical form; those that pass the filter are joined to the list,
which removes false positives.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import ascii_lower

#: Longs in a block, bits that a key sets, bits of filter a key, and the most blocks of a filter (8 MB).
WORDS, HASHES, BITS_PER_KEY, MOST_BLOCKS = 8, 6, 12, 1 << 17
#: A list of at most so many keys is broadcast; a longer one is joined by a shuffle, with its copies salted.
BROADCAST_KEYS, SALTS = 50_000, 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? or #. Else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(url: Column) -> Column:
    """Without scheme, ``www.``, default port, fragment and closing slash; host lower-cased; parameters sorted,
    tracking ones (utm_*, ref) left out."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_[^=]*|ref)(=|$)")))
    plain = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    return F.concat(F.lit("="), plain, F.regexp_replace(path, r"/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


class BlockedBloom:
    """Bits of a list's keys, by two hashes of each; built from partial sums, at most MOST_BLOCKS x WORDS longs."""

    def __init__(self, listed: DataFrame, n: int):
        self.blocks = min(MOST_BLOCKS, 1 << max(0, (n * BITS_PER_KEY // 512)).bit_length())
        spots = F.array(*[F.shiftrightunsigned("h2", 9 * i).bitwiseAND(511) for i in range(HASHES)])
        keys = listed.select(F.pmod(F.xxhash64("key"), F.lit(self.blocks)).alias("block"), F.xxhash64("key", F.lit(1)).alias("h2"))
        bits = keys.select("block", F.explode(spots).alias("bit"))
        rows = bits.groupBy("block", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("w")).collect()
        self.words = np.zeros(self.blocks * WORDS, np.int64)
        for r in rows:
            self.words[r["block"] * WORDS + r["word"]] = r["w"]

    def test(self, spark, h1: Column, h2: Column) -> Column:
        """May the key with these hashes be listed?"""
        words, blocks = spark.sparkContext.broadcast(self.words), self.blocks

        @F.pandas_udf("boolean")
        def possible(a: pd.Series, b: pd.Series) -> pd.Series:
            at, two = np.mod(a.to_numpy(np.int64), blocks) * WORDS, b.to_numpy(np.int64).view(np.uint64)
            ok, bits = np.ones(len(at), bool), words.value.view(np.uint64)
            for i in range(HASHES):
                spot = two >> np.uint64(9 * i) & np.uint64(511)
                ok &= (bits[at + (spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)
            return pd.Series(ok)

        return possible(h1, h2)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every page.

    ``rules``: host, path, verdict; a rule fits its host and all subdomains if the path starts with the rule's; the
    longest wins (ties: the longer host). ``listed``: url; a page that no rule fits is blocked if its canonical URL
    is that of a listed one, else allowed. Null urls, and those without ``://``, have empty host and path, no rule,
    and are allowed. Null rows of the lists are left out, repeated ones count once. Repeated pages are judged each;
    other columns are ignored; empty tables are fine.
    """
    spark = pages.sparkSession
    rule_keys = rules.where("host is not null and path is not null").select(F.concat(F.lit("/"), "host", "path").alias("key"), F.length("host").alias("hosts"), F.length("path").alias("paths"), "verdict", F.concat("host", "path").alias("rule"), F.col("host").alias("rule_host"))
    url_keys = listed.where(f"`url` is not null and instr(url, '://') > 0").select(canonical(F.col("url")).alias("key"), F.lit(0).alias("hosts"), F.lit(0).alias("paths"), F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("rule"))
    keys = rule_keys.drop("rule_host").unionByName(url_keys).groupBy("key").agg(*[F.min_by(c, "verdict").alias(c) for c in ("hosts", "paths", "verdict", "rule")])
    n = keys.count()
    kinds = rule_keys.select("paths", F.size(F.split("rule_host", r"\.")).alias("labels")).distinct().collect()
    lengths, counts = sorted({r["paths"] for r in kinds}), sorted({r["labels"] for r in kinds})
    bloom = BlockedBloom(keys, n)

    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("row", "page_id", host.alias("host"), path.alias("path"), F.when(F.instr("url", "://") > 0, canonical(F.col("url"))).alias("own"))
    # Suffixes of as many labels as rules have, so that a host of very many labels costs no more.
    dots = F.length("host") - F.length(F.replace("host", F.lit(".")))
    suffixes = F.array_compact(F.array(*[F.when(dots >= n - 1, F.substring_index("host", ".", -n)) for n in counts]).cast("array<string>"))
    heads = F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda x: x <= F.length("path"))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda x: F.concat(F.lit("/"), s, F.substring("path", F.lit(1), x)))))
    tests = rows.select("*", F.explode(F.array_distinct(F.concat(F.when(F.col("own").isNull(), F.array().cast("array<string>")).otherwise(F.array("own")), F.when(F.col("own").isNotNull(), pairs).otherwise(F.array().cast("array<string>"))))).alias("key"))
    tests = tests.select("row", "key", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"))
    hits = tests.where(bloom.test(spark, F.col("h1"), F.col("h2"))).select("row", "key")
    if n <= BROADCAST_KEYS:
        exact = hits.join(F.broadcast(keys), "key")
    else:
        salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        exact = hits.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    # The longest rule first; listed URLs, of length zero, only where no rule fits.
    best = exact.groupBy("row").agg(F.max(F.struct(F.expr("hosts + paths"), "hosts", "rule", "verdict")).alias("best"))
    found = rows.select("row", "page_id", "host", "path").join(best, "row", "left")
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), (F.col("best").isNotNull() & F.col("best.rule").isNull()).alias("listed"))
