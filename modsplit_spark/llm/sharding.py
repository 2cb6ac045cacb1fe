"""Sharding by longest-processing-time scheduling: groups stay together, sizes come out near equal.

LPT takes the items by falling size and gives each to the least-loaded shard, found through a heap.
A group of at least ``total / (shards * grain)`` bytes is an item of its own; there are at most
``shards * grain`` such groups, however large the table. The many smaller groups are hashed into bundles, which
are items too: ``shards * bundles`` coarse ones, and as many of two finer tiers, to which one group in 64 and one in
4,096 go. The finest come last and level what the coarse ones leave. So the heap sees a bounded number of items
(under 23,000 for 16 shards), at every input size alike, and its answer is a broadcast table of that bounded size.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modsplit_spark.sources.workspace import materialize_observed

GRAIN = 1024
BUNDLES = 128
#: Of so many groups one goes to a finer tier of bundles, and of that many times as many one to the finest.
FINER = 64


def longest_first(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Shard of each item: by falling size (ties by key), each to the least-loaded shard (ties to the lowest)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard_by_size(rows: DataFrame, shards: int, group: str = "group_key", size: str = "size", rows_per_slot_range: int = 50_000) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` added (columns of these names are replaced); rows that share ``group`` (binary) share a shard.

    Null groups form one group. Slots count from 0 without gaps within a shard, by hashed ranges of written row
    numbers, so they rest on no column: rows that are equal in all columns get slots of their own, and one id may stand
    in any number of rows. An empty table gives an empty result. Names that begin with ``_`` are the operator's own.
    ``rows`` are evaluated once and written.
    """
    spark = rows.sparkSession
    numbered = rows.withColumn("_group", F.coalesce(F.col(group), F.lit(b"").cast("binary"))).withColumn("_row", F.monotonically_increasing_id())
    rows, seen = materialize_observed(numbered, "shard-rows", F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    least = max(1, -(-(seen["bytes"] or 0) // (shards * GRAIN)))
    hashed, fine = F.xxhash64("_group"), F.shiftrightunsigned(F.xxhash64("_group"), 32).bitwiseAND(F.lit(FINER * FINER - 1))
    tier = F.when(fine == 0, 2).when(fine < FINER, 1).otherwise(0)
    bundle = (tier * shards * BUNDLES + F.pmod(hashed, F.lit(shards * BUNDLES))).cast("int")
    groups = rows.groupBy("_group").agg(F.sum(size).alias("_bytes"))
    alone = F.col("_bytes") >= least
    items = groups.groupBy(F.when(alone, F.col("_group")).alias("_group"), F.when(~alone, bundle).alias("_bundle")).agg(F.sum("_bytes").alias("_bytes"))
    placed = longest_first([(n, ("b", b.to_bytes(4, "big")) if g is None else ("a", bytes(g))) for g, b, n in items.collect()], shards)
    of_group = spark.createDataFrame([(k, s) for (kind, k), s in placed.items() if kind == "a"], "_group binary, _of_group int")
    of_bundle = spark.createDataFrame([(int.from_bytes(k, "big"), s) for (kind, k), s in placed.items() if kind == "b"], "_bundle int, _of_bundle int")
    dealt = (
        rows.withColumn("_bundle", bundle)
        .join(F.broadcast(of_group), "_group", "left")
        .join(F.broadcast(of_bundle), "_bundle", "left")
        .withColumn("shard", F.coalesce("_of_group", "_of_bundle"))
    )
    return with_slots(dealt, seen["rows"], rows_per_slot_range).drop("_row", "_group", "_bundle", "_of_group", "_of_bundle")


def with_slots(dealt: DataFrame, count: int, rows_per_range: int) -> DataFrame:
    """Number the rows of each ``shard`` from 0. Rows are ranked by ``_row`` in hashed ranges of bounded size,
    and a small table of range sizes gives each range its first number."""
    ranges = max(64, count // rows_per_range)
    dealt = dealt.withColumn("_range", F.pmod(F.xxhash64("_row", F.lit(7)), F.lit(ranges)).cast("int"))
    within = dealt.withColumn("_rank", F.row_number().over(W.partitionBy("shard", "_range").orderBy("_row")) - 1)
    sizes = dealt.groupBy("shard", "_range").count()
    before = sizes.select("shard", "_range", (F.sum("count").over(W.partitionBy("shard").orderBy("_range")) - F.col("count")).alias("_before"))
    joined = within.join(before, ["shard", "_range"])
    return joined.withColumn("slot", F.col("_before") + F.col("_rank")).drop("_range", "_rank", "_before")


def shard_documents(documents: DataFrame, shards: int = 16) -> DataFrame:
    """The digest of ``op2``: every document with its size, checksum, shard and slot under the law ``bytes``.

    Groups are equal texts (by MD5); null counts as the empty text (size 1). Size is UTF-8 bytes plus 1. The texts, of any
    length, are read once; null and repeated ids are rows like others.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("group_key"))
    return shard_by_size(rows, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
