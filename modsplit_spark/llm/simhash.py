"""SimHash near-duplicates found by the generalised pigeonhole principle (GPH).

If two 64-bit fingerprints differ in at most ``t`` bits and the bits are split into ``m`` parts with
thresholds ``t_1 .. t_m`` that add up to ``t - m + 1``, then in some part they differ in at most that
part's threshold (a part with threshold -1 is not probed). The parts need not be equal: bits that
agree too often to tell fingerprints apart are spread so that every part stays selective, and a
dynamic programme gives each part the threshold that keeps the estimated candidate count least.

Steps, all on distinct fingerprints: bit statistics over all of them; parts and thresholds; probe
keys (each fingerprint's part, and its variants within the threshold); links between fingerprints
that share a key and verify; components by star rounds. Keys that more than ``PAIR_LIMIT``
fingerprints share are not paired. There, every fingerprint and its one-bit neighbours become keys:
two fingerprints meet in such a key exactly if they differ in at most two bits, at most 65 can
share one, and one edge per row links them, so no group is ever gathered or squared.

``keep_one``, the pipeline's stage, goes on from prints of 5-word shingle sets: ``neighbours`` gives each the most central print within
``RADIUS`` bits by the same parts and thresholds, and ``near_copies`` compares the two texts and looks for what lies further apart.
"""

from __future__ import annotations

import itertools
import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modsplit_spark.llm import near_copies
from modsplit_spark.llm.bytegrams import parts
from modsplit_spark.operators.components import connected_components
from modsplit_spark.sources.workspace import materialize

BITS = 64
SEED = 42
PAIR_LIMIT = 64
#: Bits of ``neighbours``. Plans have 5 keys a text at 230,000 texts and 46 at 14 million (30 GB); 5 bits take 36 and 67, 6 bits 52 and 298.
RADIUS = 4
#: Prints of a key up to which ``neighbours`` compares each with each; chance alone gives 150 at 14 million.
CROWD = 512


def majority(raw: np.ndarray) -> int:
    """The signed integer of the bits that are set in over half of the rows of 8 bytes."""
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(raw), 1 << 15):
        votes += np.unpackbits(raw[i : i + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(raw)).tobytes(), "big", signed=True)


def set_print(hashes: np.ndarray) -> int:
    """The SimHash of a set of 64-bit hashes (0 if it is empty)."""
    return majority(hashes.astype(">u8").view(np.uint8).reshape(-1, 8))


def fingerprint(text: str | None, words: int) -> int:
    """The 64-bit SimHash of a text as a signed integer (0 if it has no word)."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if not n:
        return 0
    line = b" ".join(tokens)
    if n <= words:
        digests, count = xxhash.xxh64_digest(line, SEED), 1
    else:
        lengths = np.fromiter(map(len, tokens), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: n - words + 1].tolist()
        digest, count = xxhash.xxh64_digest, n - words + 1
        digests = b"".join([digest(line[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)])
    return majority(np.frombuffer(digests, np.uint8).reshape(count, 8))


def _fingerprints(batches, words: int):
    for batch in parts(batches):
        prints = pa.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "print"])


def with_fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, print long)``: words are runs of non-space bytes, A-Z lower-cased, ``words`` to a shingle."""
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(partial(_fingerprints, words=words), T.StructType([documents.schema["doc_id"], T.StructField("print", T.LongType())]))


# ---------------------------------------------------------------- statistics, parts and thresholds


def _bit_counts(batches):
    """One row per task: how often each pair of bits is set together (and, on the diagonal, each bit)."""
    both, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        raw = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8)
        for i in range(0, len(raw), 1 << 16):
            x = np.unpackbits(raw[i : i + (1 << 16)], axis=1).astype(np.float32)
            both += x.T @ x
            n += len(x)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([both.ravel().tolist()], pa.list_(pa.float64()))], ["n", "both"])


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Count of fingerprints, and the 64 x 64 matrix of the share of them with both bits set."""
    parts = prints.select("print").mapInArrow(_bit_counts, "n long, both array<double>")
    sums = parts.select("n", F.posexplode("both").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    both, n = np.zeros(BITS * BITS), 0
    for r in sums:
        both[r["at"]], n = r["v"], r["n"]
    return int(n), both.reshape(BITS, BITS) / max(n, 1)


def group_bits(both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` parts of bits. Bits are taken from the least even on; each goes to the part, among the
    shortest ones, with which it is least correlated, so that no part holds only bits that agree."""
    p = both.diagonal()
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both - np.outer(p, p)) / np.outer(spread, spread))
    parts: list[list[int]] = [[] for _ in range(m)]
    for bit in sorted(range(BITS), key=lambda b: (spread[b], b)):
        short = min(map(len, parts))
        k = min((k for k in range(m) if len(parts[k]) == short), key=lambda k: (sum(corr[bit, b] for b in parts[k]), k))
        parts[k].append(bit)
    return [sorted(x) for x in parts]


def within(both: np.ndarray, bits: list[int], t: int) -> float:
    """Estimated share of pairs that differ in at most ``t`` of ``bits``, from each bit's bias."""
    left = np.zeros(t + 2)
    left[0] = 1.0
    for b in bits:
        differ = 2 * both[b, b] * (1 - both[b, b])
        left[1:] = left[1:] * (1 - differ) + left[:-1] * differ
        left[0] *= 1 - differ
        left[-1] = 0
    return float(left[: t + 1].sum())


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Least sum of ``costs[i][t_i + 1]`` with thresholds ``t_i >= -1`` that add up to ``total`` (dynamic programme)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, len(row) - 1):
                key, value = used + t, cost + row[t + 1]
                if key not in new or value < new[key][0]:
                    new[key] = (value, [*chosen, t])
        best = new
    return best[total]


def plan_parts(n: int, both: np.ndarray, t: int) -> list[tuple[list[int], int]]:
    """The cheapest parts and thresholds for ``n`` fingerprints: keys to probe plus candidates to verify."""
    found = []
    for m in range(1, t + 3):
        parts = group_bits(both, m)
        costs = [
            [0.0] + [n * sum(math.comb(len(bits), j) for j in range(k + 1)) + 0.2 * n * n / 2 * within(both, bits, k) for k in range(t + 1)]
            for bits in parts
        ]
        cost, chosen = allocate(costs, t - m + 1)
        found.append((cost, m, [(bits, k) for bits, k in zip(parts, chosen, strict=True) if k >= 0]))
    return min(found)[2]


# ---------------------------------------------------------------- probing, links, components


def _mask(bits) -> int:
    """Signed long with ``bits`` set; bit 0 is the highest, as in the statistics."""
    x = sum(1 << (BITS - 1 - b) for b in bits)
    return x - (1 << BITS) if x >> (BITS - 1) else x


def shared_keys(prints: DataFrame, t: int) -> DataFrame:
    """``(part, key, print, own, n, any_own)``: the probe keys of ``prints`` that ``n`` > 1 of them share, one of these by its own part.
    Any two prints that differ in at most ``t`` bits share a key that is one's own."""
    n, both = bit_statistics(prints)
    plan = plan_parts(n, both, t)
    probes = []
    for i, (bits, k) in enumerate(plan):
        flips = [_mask(c) for j in range(k + 1) for c in itertools.combinations(bits, j)]
        value = F.col("print").bitwiseAND(F.lit(_mask(bits)))
        # A key is the part with its varied bits; of two prints that differ in j <= k bits of the part one meets the other's own key.
        own = prints.select("print", F.lit(i).alias("part"), value.alias("key"), F.lit(True).alias("own"))
        probes.append(own)
        if len(flips) > 1:
            varied = prints.select("print", F.explode(F.array(*[F.lit(x) for x in flips[1:]])).alias("flip"))
            probes.append(varied.select("print", F.lit(i).alias("part"), value.bitwiseXOR(F.col("flip")).alias("key"), F.lit(False).alias("own")))
    keyed = probes[0]
    for more in probes[1:]:
        keyed = keyed.unionByName(more)
    sizes = keyed.groupBy("part", "key").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).where("n > 1 and any_own")
    return materialize(keyed.join(sizes, ["part", "key"]), "simhash-keys")


def links(prints: DataFrame, t: int = 2) -> DataFrame:
    """``(a, b)`` with a < b: links among the distinct fingerprints of ``prints`` (column ``print``)
    whose connected components are those of all pairs that differ in at most ``t`` (0 to 2) bits.
    Keys shared by up to ``PAIR_LIMIT`` fingerprints give every such pair; larger ones give a star
    for each one-bit neighbourhood instead, through the fingerprint or a mid-point that is a node too."""
    if not 0 <= t <= 2:
        raise ValueError("links are exact for 0 to 2 differing bits")
    shared = shared_keys(prints, t)
    few = shared.where(F.col("n") <= PAIR_LIMIT)
    left = few.where("own").select("part", "key", F.col("print").alias("x"))
    right = few.select("part", "key", F.col("print").alias("y"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= t
    pairs = left.join(right, (left["part"] == right["part"]) & (left["key"] == right["key"]) & (F.col("x") != F.col("y")) & near)
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    many = shared.where(F.col("n") > PAIR_LIMIT).select("print").distinct()
    return pairs.distinct().unionByName(neighbour_stars(many, t))


def neighbour_stars(prints: DataFrame, t: int) -> DataFrame:
    """Links that join any two of ``prints`` at ``t`` or fewer bits, linear in their number.

    For t = 2 the keys are each fingerprint and its 64 one-bit neighbours; for t = 1 the 64 values
    with one bit cleared, tagged by the bit. Two fingerprints share a key exactly if they link, so the
    least holder of a key can stand for all its holders."""
    if t == 0:
        return prints.select(F.col("print").alias("a"), F.col("print").alias("b")).where("false")
    single = [_mask([b]) for b in range(BITS)]
    if t == 2:
        keys = prints.select("print", F.explode(F.array(F.lit(0).cast("long"), *[F.lit(x) for x in single])).alias("flip")).select("print", F.lit(0).alias("tag"), F.col("print").bitwiseXOR(F.col("flip")).alias("key"))
    else:
        keys = prints.select("print", F.posexplode(F.array(*[F.lit(x) for x in single])).alias("tag", "flip")).select("print", "tag", F.col("print").bitwiseAND(F.bitwise_not("flip")).alias("key"))
    least = keys.groupBy("tag", "key").agg(F.min("print").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keys.join(least, ["tag", "key"]).where("a != print").select("a", F.col("print").alias("b")).distinct()


def neighbours(prints: DataFrame, t: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """``(hub, print)``: for each of the distinct ``prints`` one other within ``t`` bits, that which meets the most prints in its own keys.

    Every print with another within ``t`` bits has a row, unless they meet only in keys of more than ``crowd`` prints: there each is compared with
    the most central print of the key alone. Work is linear in keys; whoever needs all pairs has to look for the rest."""
    shared = shared_keys(prints, t)
    met = materialize(shared.where("own").groupBy("print").agg(F.sum("n").alias("met")), "simhash-met")
    few, many = shared.where(F.col("n") <= crowd), shared.where(F.col("n") > crowd)
    left = few.where("own").select("part", "key", F.col("print").alias("x"))
    right = few.select("part", "key", F.col("print").alias("y"), "own")
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= t
    pairs = left.join(right, ["part", "key"]).where((F.col("x") != F.col("y")) & (~F.col("own") | (F.col("x") < F.col("y"))) & near).select("x", "y")
    ranked = many.join(met, "print", "left").select("part", "key", "print", F.struct(F.coalesce("met", F.lit(0)).alias("met"), "print").alias("rank"))
    stars = ranked.join(ranked.groupBy("part", "key").agg(F.max("rank").alias("top")), ["part", "key"]).select(F.col("print").alias("x"), F.col("top.print").alias("y")).where((F.col("x") != F.col("y")) & near)
    found = materialize(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(stars), "simhash-near")
    best = found.join(met.withColumnRenamed("print", "y"), "y", "left").groupBy("x").agg(F.max(F.struct(F.coalesce("met", F.lit(0)).alias("met"), "y")).alias("top"))
    return best.select(F.col("top.y").alias("hub"), F.col("x").alias("print"))


def keep_one(documents: DataFrame) -> DataFrame:
    """The pipeline's stage: near copies found by SimHash first, then by what ``near_copies`` adds; see its ``keep_one``."""
    return near_copies.keep_one(documents, set_print, neighbours)


def near_duplicates(documents: DataFrame, words: int = 3, t: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``documents``.

    Fingerprints that differ in at most ``t`` bits link; component_id is the least doc_id that can be
    reached, the document's own included. A text that is null, empty or without a word has fingerprint
    zero and links like any other; one with fewer than ``words`` words is one shingle. Null doc_ids are
    kept and never name a component unless all its ids are null. Repeated rows stay repeated.
    """
    rows = materialize(with_fingerprints(documents, words), "simhash")
    ids = rows.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    joined = connected_components(links(ids.select("print"), t), "a", "b")
    names = ids.join(joined.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = names.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_print = names.join(least, "component").select("print", "component_id")
    return rows.join(of_print, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
