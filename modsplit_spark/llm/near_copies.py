"""Near copies by word shingles: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Texts link only if their whole shingle sets say so. SimHash goes first: each text is compared with the most central one whose
fingerprint is within a few bits of its own, or the same. At similarity 0.8 about 10 of 64 bits differ, up to 15 and more, and at such a radius no part
of a fingerprint is selective; so what SimHash leaves apart meets through MinHash bands. With ``BANDS`` bands of
``ROWS`` values, two texts at similarity 0.8 miss every band with a chance of 3 in a million, and more alike ones
less often.

Texts that share a band key (a bucket) are compared in two rounds. First all with the bucket's hub, its text that meets the most others in
all its buckets: in a group of copies that is the text nearest to the original, so that even where copies are alike only by way of it, the group
costs one comparison each. Then, where a bucket still holds several components, all of its texts outside
its largest component with all texts of other components, but for pairs that can't be alike: because more of their shingles stand in
no other text of an open bucket than similarity allows, or because their parity maps differ in more bits than
alike sets can differ in shingles. Pairs within a component need no comparison, as they
can't change it; so no pair is left out. A text with more than a ninth of its shingles for itself can be alike with smaller texts only, and
only with such as have less for themselves; the join leaves out what follows from that. In a group whose texts are all just short of alike
it still meets the square of the number of those with less, but only pairs that pass these bounds, hardly more than the links, leave it to be compared in full.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modsplit_spark.llm.bytegrams import parts, slices
from modsplit_spark.llm.wordhash import BASES, mix, range_hash, range_sums, word_hashes
from modsplit_spark.operators.components import connected_components
from modsplit_spark.sources.workspace import materialize

WORDS = 5
#: Similarity as a fraction, so that the bound is met exactly: 4 / 5.
OVER, UNDER = 4, 5
BANDS, ROWS = 32, 5
#: Longs of a parity map: it tells texts of up to about 4,000 shingles apart, longer ones go to the full comparison.
MAP_WORDS = 32
#: Pairs of one text that a task takes together.
SALT_PAIRS = 64
_RNG = np.random.default_rng(5)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; A-Z count as a-z, a shorter text is one shingle, one without a word has none."""
    words, owner, *_ = word_hashes([t.lower() for t in texts])
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    n = np.where(count > 0, np.maximum(count - WORDS + 1, 1), 0)
    last = np.cumsum(n)
    text = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(text)) - (last - n)[text] + first[text]
    hashes = range_hash(range_sums(words, BASES[1]), at, np.minimum(at + WORDS, (first + count)[text]), BASES[1])
    return [np.unique(hashes[e - k : e]) for e, k in zip(last.tolist(), n.tolist(), strict=True)]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BANDS`` keys for each set; empty sets share theirs."""
    keys = np.zeros((len(sets), BANDS), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        hashes = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        least = [mix(np.minimum.reduceat(hashes * f + s, starts)) for f, s in zip(_FACTORS, _SHIFTS, strict=True)]
        for band in range(BANDS):
            key = np.full(len(full), band + 1, np.uint64)
            for value in least[band * ROWS : (band + 1) * ROWS]:
                key = mix(key * np.uint64(BASES[2]) + value)
            keys[full, band] = key
    return keys.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity; two empty ones do."""
    both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)) if len(a) and len(b) else 0
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def _sketches(batches, fingerprint):
    for batch in parts(batches):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        for i, j in slices(texts):
            sets = shingle_sets(texts[i:j])
            keys = pa.array(list(band_keys(sets)), pa.list_(pa.int64()))
            prints = pa.array([fingerprint(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), keys, prints], ["_text", "size", "bands", "print"])


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """``MAP_WORDS`` longs with one bit a cell: whether the cell, a shingle's last bits, has an odd number of shingles.
    Two sets differ in at least as many shingles as their maps differ in bits, as one shingle changes one bit."""
    odd = np.bincount((shingles & np.uint64(64 * MAP_WORDS - 1)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(batches):
    """Each text's set as bytes, so that it is made once, in however many pairs it is; and its parity map."""
    for batch in parts(batches, 64):
        sets = [shingle_sets([(t or "").encode("utf-8", "surrogatepass")])[0] for t in batch.column(1).to_pylist()]
        maps = pa.array([parity_map(x) for x in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary()), maps], ["id", "shingles", "parity"])


def _single_shingles(batches):
    for batch in parts(batches, 64):
        held = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
        ids = np.repeat(batch.column("id").to_numpy(), [len(x) for x in held])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([*held, np.zeros(0, np.int64)]))], ["id", "shingle"])


def _alike(batches):
    for batch in parts(batches, 64):
        pairs = zip(*(batch.column(i).to_pylist() for i in (2, 3)), strict=True)
        good = [alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in pairs]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are alike. However many pairs a text ``a`` is in, they are dealt to tasks in small lots."""
    lots = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_PAIRS).cast("int").alias("lots"))
    left = lots.join(sets.withColumnRenamed("id", "a"), "a").select("a", F.col("shingles").alias("set_a"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    dealt = pairs.join(lots, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int").alias("lot"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    return dealt.join(left, ["a", "lot"]).join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(_alike, "a long, b long")


def fit(x, y):
    """Sets whose sizes differ too much can't be alike."""
    return UNDER * F.least(x, y) >= OVER * F.greatest(x, y)


def reaching(members: DataFrame) -> DataFrame:
    """``members`` less those that reach no other. Of two alike texts at least the smaller is open (reaches texts of its own size or larger):
    if neither were, each would have to be smaller than the other. So a text that isn't open meets open ones only, and those no larger than it reaches."""
    least = members.where("open").groupBy("bucket").agg(F.min("size").alias("least_open"))
    return members.join(least, "bucket").where(F.col("open") | (F.col("reach") >= F.col("least_open"))).drop("least_open")


def late_pairs(members: DataFrame) -> DataFrame:
    """``(a, b)`` of one bucket and different components, one of them stray, that the bounds don't rule out.
    ``members`` has bucket, id, size, component, stray, reach, open and parity."""
    members = reaching(members)
    left = members.where("stray").select("bucket", *[F.col(x).alias(f"{x}_a") for x in ("id", "size", "component", "reach", "open", "parity")])
    # Alike texts differ in at most a ninth of the sum of their sizes, and their maps in no more than they do.
    differ = F.aggregate(F.zip_with("parity_a", "parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    near = (OVER + UNDER) * differ <= (UNDER - OVER) * (F.col("size_a") + F.col("size"))
    bounds = (F.col("component_a") != F.col("component")) & (F.col("size") <= F.col("reach_a")) & (F.col("size_a") <= F.col("reach")) & fit("size_a", "size") & near
    # Any stray text with the open ones, and the open strays with the others that are not open. Two open strays meet once.
    with_open = left.join(members.where("open"), "bucket").where(bounds & (~F.col("stray") | ~F.col("open_a") | (F.col("id_a") < F.col("id"))))
    others = left.where("open_a").join(members.where("not open and not stray"), "bucket").where(bounds)
    return with_open.unionByName(others).select(F.col("id_a").alias("a"), F.col("id").alias("b"))


def near_prints(sketches: DataFrame, neighbours) -> DataFrame:
    """``(a, b)``: texts ``b`` to compare with ``a`` as their fingerprints are the same or ``neighbours`` pairs them; sizes fit."""
    first = materialize(sketches.groupBy("print").agg(F.min(F.struct("id", "size")).alias("a")), "simhash-first")
    same = sketches.join(first, "print").where(F.col("id") != F.col("a.id")).select("a", F.struct("id", "size").alias("b"))
    near = neighbours(first.select("print")).join(first.withColumnRenamed("a", "b"), "print").join(first.withColumnRenamed("print", "hub"), "hub").select("a", "b")
    return same.unionByName(near).where(fit("a.size", "b.size")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def _apart(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ends are in different components of ``of``."""
    ends = pairs.join(of.select(F.col("node").alias("a"), F.col("component").alias("of_a")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("component").alias("of_b")), "b", "left")
    return ends.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def components(sketches: DataFrame, texts_of, neighbours) -> DataFrame:
    """``(node, component)`` of all texts with a near copy. ``sketches`` has id, size, bands and print, one row a text;
    ``texts_of`` gives (id, text) for a table of ids, ``neighbours`` (hub, print) for one of prints."""
    near = materialize(near_prints(sketches, neighbours), "simhash-pairs")
    keys = sketches.select("id", "size", F.explode("bands").alias("bucket"))
    shared = materialize(keys.join(keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket"), "near-buckets")
    met = shared.groupBy("id").agg(F.sum("n").alias("met"))
    hubs = shared.join(met, "id").groupBy("bucket").agg(F.max(F.struct("met", "id", "size")).alias("hub"))
    shared = materialize(shared.join(hubs, "bucket").drop("n"), "near-hubs")
    wanted = shared.select("id").unionByName(near.select(F.col("a").alias("id"))).unionByName(near.select(F.col("b").alias("id"))).distinct()
    sets = materialize(texts_of(wanted).mapInArrow(_sets, "id long, shingles binary, parity array<long>"), "near-sets")
    links = materialize(_links(near, sets), "simhash-links")
    of = connected_components(links)
    # Of what SimHash leaves apart, the best of a text's hubs first; the others only if it is not in one component with them by then.
    best = shared.groupBy("id", "size").agg(F.max("hub").alias("hub")).where((F.col("id") != F.col("hub.id")) & fit("size", "hub.size"))
    tried = materialize(_apart(best.select(F.col("hub.id").alias("a"), F.col("id").alias("b")), of), "near-pairs")
    links = links.unionByName(materialize(_links(tried, sets), "near-links"))
    of = connected_components(links)
    apart = shared.where((F.col("id") != F.col("hub.id")) & fit("size", "hub.size")).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
    apart = materialize(_apart(apart, of).join(tried, ["a", "b"], "left_anti"), "near-pairs")
    first = near.unionByName(tried).unionByName(apart)
    links = links.unionByName(materialize(_links(apart, sets), "near-links"))
    joined = connected_components(links)
    named = shared.join(joined.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "size", F.coalesce("component", "id").alias("component"))
    counts = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_ones = counts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("several")).where("several > 1")
    members = materialize(named.join(open_ones, "bucket").select("bucket", "id", "size", "component", (F.col("component") != F.col("most.component")).alias("stray")), "near-open")
    # A shingle of one text alone is shared with no other; of two alike texts 4 / 9 of all their shingles stand in both.
    singles = sets.join(members.select("id").distinct(), "id").mapInArrow(_single_shingles, "id long, shingle long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    alone = singles.where("n = 1").groupBy("id").agg(F.count("*").alias("alone"))
    common = F.col("size") - F.coalesce("alone", F.lit(0))
    # Alike texts have at least 4 / 9 of the sum of their sizes in common, which bounds the size of what a text can be alike with.
    reach = F.floor((OVER + UNDER) * common / OVER) - F.col("size")
    members = members.join(alone, "id", "left").where(UNDER * common >= OVER * F.col("size")).withColumn("reach", reach)
    members = members.withColumn("open", F.col("reach") >= F.col("size"))
    members = materialize(members.join(sets.select("id", "parity"), "id").select("bucket", "id", "size", "component", "stray", "reach", "open", "parity"), "near-open")
    late = late_pairs(members).distinct()
    tried = first.unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    late = materialize(late.join(tried, ["a", "b"], "left_anti"), "near-pairs")
    return connected_components(links.unionByName(_links(late, sets)))


def keep_one(documents: DataFrame, fingerprint, neighbours) -> DataFrame:
    """The rows of ``documents``, all columns, less their near copies: of every connected component of alike texts one row stays,
    that with the least doc_id (null ones last; ties by hashes of text and row). Of rows that are equal in all columns one stays.
    Texts without a word, null ones too, are alike. Equal texts are known by their MD5, and each different text has a number of its
    own from then on; rows of one text are told apart by 64-bit hashes of all columns. An empty table gives an empty result, a text of any
    length is one row, and columns of other names are kept unless they begin with ``_``, which are the operator's own.
    ``fingerprint`` makes a long of a set's hashes, ``neighbours`` pairs prints (``simhash.set_print`` and ``simhash.neighbours``)."""
    columns = documents.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = documents.select("*", F.unhex(F.md5(text)).alias("_text"), F.xxhash64(*columns).alias("_row"))
    rows = keyed.groupBy("_text", "_row", "doc_id").agg(F.count("*").alias("_n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text", "_row", "_n")
    sketched = keyed.select("_text", text.alias("text")).mapInArrow(partial(_sketches, fingerprint=fingerprint), "_text binary, size long, bands array<long>, print long")
    sketched = sketched.groupBy("_text").agg(F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("print").alias("print"))
    sketches = materialize(sketched.withColumn("id", F.monotonically_increasing_id()), "near-sketches")
    first = rows.groupBy("_text").agg(F.min(order).alias("first"))
    least = materialize(first.join(sketches.select("_text", "id"), "_text").select("id", "first"), "near-first")

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = least.join(ids, "id").select("id", "first._text", "first._row")
        return keyed.select("_text", "_row", text.alias("text")).join(wanted, ["_text", "_row"]).groupBy("id").agg(F.first("text").alias("text"))

    joined = components(sketches, texts_of, neighbours)
    named = least.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    kept = materialize(named.groupBy("component").agg(F.min("first").alias("first")).select("first._text", "first._row", "first._n"), "near-kept")
    once = keyed.join(kept.where("_n = 1"), ["_text", "_row"]).select(*columns)
    more = keyed.join(kept.where("_n > 1"), ["_text", "_row"]).dropDuplicates(["_text", "_row"]).select(*columns)
    return once.unionByName(more)
