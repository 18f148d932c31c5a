"""URL filters: listed canonical prefixes decide, found by a blocked Bloom filter and confirmed by a hash join.

A rule is a host and the beginning of a path; it fits the host and all its subdomains. A URL's candidates are the ends
of its host, label by label, each with the beginnings of its path that are as long as some rule's path. Candidates
that pass the filter are joined with the rules, which removes false positives. The longest rule wins; of equally
long ones the one with the longer host, and of contradicting copies the one that blocks.

Defined cases: a null URL, or one without ``://``, has an empty host and path, which no rule fits; without a rule
the verdict is the method's: an unlisted URL is allowed. Rules with a null part or an empty host are ignored; without rules all is
allowed. Rows that repeat, and rows without an id, are judged one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import broadcast_if_small, materialize

ALLOW, BLOCK = "allow", "block"
UNLISTED = ALLOW
KEYS_PER_BLOCK = 4
"""Listed keys per 64-bit block of the filter, on average; with four bits a key about one candidate in 200 passes wrongly."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules from (host, path, verdict)."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def url_host(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _key(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(key, F.lit(blocks))


def _bits(key: Column) -> Column:
    """Four of the 64 bits of a block, from bits of the key that do not choose the block."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(key, 20 + 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """Blocks of a filter over the ``key`` column: ``block`` and its 64 ``bits``."""
    return listed.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_bits(F.col("key"))).alias("bits"))


def _candidates(urls: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """``url`` with each end of its host and each beginning of its path of one of ``lengths``."""
    labels = F.split(F.col("host"), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels) - k + 1)))
    fronts = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("path")), lambda n: F.col("path").substr(F.lit(1), n)
    )
    by_end = urls.filter("host <> ''").select("url", "path", F.explode(ends).alias("listed_host"))
    return by_end.select("url", "listed_host", F.explode(fronts).alias("listed_path"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: its id, ``host``, ``path``, the ``rule`` that fits, if any, and the ``verdict``."""
    listed = rules.dropna(subset=["host", "path", "verdict"]).filter("host <> ''")
    listed = listed.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    listed = materialize(listed.select("host", "path", "verdict", _key(F.col("host"), F.col("path")).alias("key")), "rules")
    blocks = max(1, listed.count() // KEYS_PER_BLOCK)
    # The filter has one short row per block; it and the rules are broadcast if few enough, else joined by shuffles.
    bloom = broadcast_if_small(materialize(bloom_filter(listed, blocks), "bloom"))
    lengths = [r[0] for r in listed.select(F.char_length("path").alias("n")).distinct().orderBy("n").collect()]

    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    parts = rows.select("url").filter("url IS NOT NULL").distinct().select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    tried = _candidates(parts, lengths or [0]).withColumn("key", _key(F.col("listed_host"), F.col("listed_path")))
    passed = tried.join(bloom, (_block(F.col("key"), blocks) == F.col("block")) & (F.col("bits").bitwiseAND(_bits(F.col("key"))) == _bits(F.col("key"))))
    exact = broadcast_if_small(listed.select("host", "path", "verdict"))
    hits = passed.join(exact, (F.col("listed_host") == F.col("host")) & (F.col("listed_path") == F.col("path")))
    rule = F.concat("listed_host", "listed_path")
    best = hits.groupBy("url").agg(
        F.max(F.struct(F.char_length(rule).alias("n"), F.char_length("listed_host").alias("m"), rule.alias("rule"), F.col("verdict"))).alias("best")
    )
    best = materialize(best.select("url", "best.rule", "best.verdict"), "judged")
    judged = rows.join(best, "url", "left")
    return judged.select(
        F.col(id_col),
        F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(url_path(F.col("url")), F.lit("")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit(UNLISTED)).alias("verdict"),
    )
