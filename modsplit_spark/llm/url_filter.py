"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A rule is a host and a path prefix. It holds for its host and every subdomain, where the url's
path starts with the rule's; the longest rule wins. The canonical form of a rule, and of what is
looked up for a url, is host (A-Z lower-cased) followed by path. A url is looked up once for every
distinct shape (number of host labels, path length) of the rules, so cost per url does not grow
with the number of rules of a shape.

The filter has one 64-bit block per ``KEYS_PER_BLOCK`` rules, at most ``max_filter_blocks`` (a
fuller filter only lets more through); its table is therefore of bounded size and is broadcast.
Look-ups that pass go to an exact join, which Spark may shuffle, so false positives vanish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS_PER_BLOCK = 4
BITS_PER_KEY = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' if there is none or url is null."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL_PARTS, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' if there is none or url is null."""
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def _bits(key: Column) -> Column:
    """The key's few bits within its block, from disjoint six-bit fields of one hash."""
    h = F.xxhash64(key, F.lit(2))
    bits = F.lit(0).cast("long")
    for i in range(BITS_PER_KEY):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return bits


def bloom_table(keys: DataFrame, blocks: int) -> DataFrame:
    """``(block, bits)``: for each 64-bit block the union of its keys' bits."""
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_bits(F.col("key"))).alias("bits"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", max_filter_blocks: int = 1 << 22) -> DataFrame:
    """``(*keep, host, path, rule, verdict)``, one row per row of ``pages``.

    ``rules`` has host, path, verdict. Rules with a null part are ignored; of rules with the same
    host and path the lesser verdict counts ('allow' before 'block'). A url that is null, empty or
    without ``://`` has empty host and path and gets ``default``, as does any url without a rule.
    Repeated rows stay repeated; other columns of ``pages`` are not read. An empty rule table
    gives every url the default.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    )
    rules = rules.groupBy(F.concat("rule_host", "rule_path").alias("key")).agg(F.min("rule_verdict").alias("rule_verdict"), F.max(F.length("rule_host")).alias("host_chars"), F.max(F.length("rule_path")).alias("path_chars"))
    labels = F.size(F.split(F.substring("key", F.lit(1), F.col("host_chars")), r"\."))
    # One row per shape, not per rule: labels and characters of a url are bounded.
    shapes = [tuple(r) for r in rules.select(labels.alias("labels"), "path_chars").distinct().collect()]
    count = rules.count()
    blocks = min(max_filter_blocks, max(1, 1 << max(0, (count // KEYS_PER_BLOCK)).bit_length()))

    host, path = F.col("_host"), F.col("_path")
    parts = F.size(F.split(host, r"\."))
    lookups = [
        F.when((parts >= n) & (F.length(path) >= p) & (host != ""), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, p)))
        for n, p in sorted(shapes)
    ] or [F.lit(None).cast("string")]
    probes = (
        pages.select(*[F.col(k).alias(f"_keep_{i}") for i, k in enumerate(keep)], url_host(F.col(url)).alias("_host"), url_path(F.col(url)).alias("_path"))
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_key", F.explode(F.array(*lookups)))
        .withColumn("_block", _block(F.col("_key"), blocks))
    )
    bloom = F.broadcast(bloom_table(rules, blocks))
    passed = probes.join(bloom, F.col("_block") == F.col("block"), "left").withColumn(
        "_key", F.when(F.col("bits").bitwiseAND(_bits(F.col("_key"))) == _bits(F.col("_key")), F.col("_key"))
    )
    # Look-ups that found nothing get a key of their own, so that they do not meet in one task.
    passed = passed.withColumn("_key", F.coalesce("_key", F.concat(F.lit("\n"), F.col("_row").cast("string"))))
    exact = passed.join(rules, F.col("_key") == F.col("key"), "left")
    best = F.struct(F.length("key"), F.col("key"))
    return exact.groupBy("_row").agg(
        *[F.first(f"_keep_{i}").alias(k) for i, k in enumerate(keep)],
        F.first("_host").alias("host"),
        F.first("_path").alias("path"),
        F.max_by("key", best).alias("rule"),
        F.coalesce(F.max_by("rule_verdict", best), F.lit(default)).alias("verdict"),
    ).drop("_row")
