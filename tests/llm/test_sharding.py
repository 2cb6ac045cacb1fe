"""Shards of bundled groups against a plain schedule, and slots of rows without ids of their own."""

import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from modsplit_spark.llm import sharding


def _gapless(got, shards):
    for s in range(shards):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_bundled_groups_against_a_plain_schedule(spark):
    rng = random.Random(4)
    texts = ["x" * rng.randrange(1, 40) + str(i) for i in range(3000)] + ["y" * (2000 + i) for i in range(12)]
    texts += [t for t in texts[:500] for _ in range(rng.randrange(1, 4))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    shards, sizes = 2, {}
    for t in texts:
        sizes[t] = sizes.get(t, 0) + len(t) + 1
    least, bundles, items = -(-sum(sizes.values()) // (shards * sharding.GRAIN)), shards * sharding.BUNDLES, {}
    name = {t: hashlib.md5(t.encode()).digest() for t in sizes}

    def bundle(h):
        fine = (h >> 32) % 4096
        return (2 if fine == 0 else 1 if fine < 64 else 0) * bundles + (h if h < 1 << 63 else h - (1 << 64)) % bundles

    of = {t: (0, name[t]) if n >= least else (1, bundle(xxhash.xxh64(name[t], seed=42).intdigest())) for t, n in sizes.items()}
    assert sum(kind for kind, _ in of.values()) > 2000 and any(b >= bundles for kind, b in of.values() if kind)
    for t, n in sizes.items():
        items[of[t]] = items.get(of[t], 0) + n
    loads, shard = [0] * shards, {}
    for item in sorted(items, key=lambda x: (-items[x], x)):
        shard[item] = loads.index(min(loads))
        loads[shard[item]] += items[item]
    got = sharding.shard_documents(rows, shards).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    assert all(r["shard"] == shard[of[texts[r["doc_id"]]]] for r in got)
    _gapless(got, shards)


def test_fifty_thousand_null_ids_and_one_id_of_many_texts(spark):
    null = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 9000).alias("text"))
    one = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("of one id "), F.col("id")).alias("text"))
    rows = null.unionByName(one)
    got = sharding.shard_documents(rows, 4).collect()
    assert len(got) == 53_000 and sum(r["doc_id"] is None for r in got) == 50_000
    _gapless(got, 4)
    assert {r["text_crc32"]: r["shard"] for r in got} == {r["text_crc32"]: r["shard"] for r in reversed(got)}
    few = sharding.shard_by_size(rows.select("doc_id", F.length("text").alias("size"), F.col("text").cast("binary").alias("group_key")), 4, rows_per_slot_range=100)
    _gapless(few.collect(), 4)


def test_null_groups_and_columns_of_the_same_names(spark):
    rows = spark.createDataFrame([(1, None, 5, "a", 9), (2, None, 6, "b", 9), (None, b"k", 7, "c", 9), (None, b"k", 7, "c", 9)], "doc_id long, group_key binary, size long, shard string, slot long")
    got = sharding.shard_by_size(rows, 2).collect()
    assert len({r["shard"] for r in got if r["group_key"] is None}) == 1 and len({r["shard"] for r in got}) == 2
    _gapless(got, 2)
    assert sharding.shard_by_size(rows.limit(0), 2).collect() == []
