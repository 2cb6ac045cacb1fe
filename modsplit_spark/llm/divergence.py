"""How far the sources of one language differ in their words: smoothed term shares, compared source against source and
source against language.

Blocks of documents are scanned first: each block's terms, sorted by (lang, source, term, document), leave one record a
run with the documents that hold the term and its occurrences, so a frequent term sends one record a block instead of one
a document. The records are repartitioned by (lang, term, source), those of frequent terms salted by block, and sorted within
partitions with the block last; one scan over that order adds up runs of equal (lang, term, source) into partial rows,
which one aggregation joins. So no key, however frequent, is gathered in one task.

A second scan in the order (lang, term, source) compares the sources of each term and leaves partial sums for pairs of
sources. A pair's sum over all kept terms is

    sum over terms in both of [f(pa, pb) - f(pa, zb) - f(za, pb) + f(za, zb)]
    + sum over all terms of f(pa, zb) + sum over all terms of f(za, pb) - V f(za, zb)

where za and zb are the shares of a term that the source does not have, so a term of one source alone is never paired.
All of it is whole-number arithmetic.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modsplit_spark.llm.bytegrams import parts
from modsplit_spark.llm.wordhash import BASES, BYTE, mix, range_hash, range_sums, word_hashes
from modsplit_spark.sources.workspace import materialize

#: A term is kept if so many documents of its language hold it.
MIN_DOCUMENTS = 10
#: Terms of a source that are listed.
TOP = 10
SCALE = 1_000_000_000
#: Bytes of text of a block; a longer text is several blocks.
BLOCK = 8 << 20
SLICE = 1 << 20
#: Records with so many documents are dealt to SALTS places by block, so no term is gathered in one task.
FREQUENT, SALTS = 64, 64
#: So many salted terms go to all tasks at most; beyond that they are joined.
FEW_TERMS = 200_000
#: Rows of one batch that goes out, and sources of one comparison.
ROWS, SIDE = 50_000, 256
#: Letters A to Z become lower case, all other ASCII but a to z becomes a blank; bytes of longer characters stay.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_RECORD = "lang string, term string, source string, block long, docs long, n long"
_RUN = "lang string, term string, source string, docs long, n long, split boolean, all_docs long, all_n long, one long"
_PAIR = "lang string, a string, b string, x long"


def _gathered(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The slices of ``buffer`` as strings."""
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    at = np.repeat(start - offsets[:-1], end - start) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(buffer[at]))


def _words(texts: list[bytes]) -> list[np.ndarray]:
    """Two hashes, text number, start and end of every term, over the texts one after another; hashed in small slices."""
    found, at, base, i = [], 0, 0, 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < SLICE):
            size += len(texts[j]) + 1
            j += 1
        h, owner, start, end, buffer = word_hashes(texts[i:j], _FOLD)
        check = range_hash(range_sums(BYTE[np.frombuffer(buffer, np.uint8)], BASES[1]), start, end, BASES[1])
        found.append((h, check, (owner + i).astype(np.int32), start + base, (end - start).astype(np.int32)))
        base, i = base + len(buffer), j
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _records(texts: list[bytes], groups: list[tuple], block: int, seen: set | None = None):
    """A block's runs: the terms of its texts sorted by (group, term, document) and counted. ``seen`` has the terms of earlier
    pieces where the block is a piece of one long document."""
    if not texts:
        return
    h, check, owner, start, length = _words(texts)
    if not len(h):
        return
    names = list(dict.fromkeys(groups))
    number = {g: i for i, g in enumerate(names)}
    group = np.array([number[g] for g in groups], np.int32)[owner]
    key = mix(h + group.astype(np.uint64) * np.uint64(BASES[2]))
    del h
    bits = np.uint64(len(texts).bit_length())
    order = np.argsort(((key >> bits) << bits) | owner.astype(np.uint64))
    for again in (False, True):
        sorted_ = [x[order] for x in (key, check, group)]
        edge = np.ones(len(order), bool)
        edge[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_])
        top = sorted_[0] >> bits
        if again or not (edge[1:] & (top[1:] == top[:-1])).any():
            break
        order = np.lexsort((owner, check, group, key))  # two terms share the upper bits
    first = np.flatnonzero(edge)
    owner = owner[order]
    edge[1:] |= owner[1:] != owner[:-1]
    docs, n = np.add.reduceat(edge.astype(np.int64), first), np.diff(np.append(first, len(order)))
    at = order[first]
    buffer = np.frombuffer((b"\n".join(texts) + b"\n").translate(_FOLD), np.uint8)
    terms = _gathered(buffer, start[at], start[at] + length[at])
    if seen is not None:
        fresh = terms.cast(pa.binary()).to_pylist()
        docs = np.array([t not in seen for t in fresh], np.int64)
        seen.update(fresh)
    which = pa.array(group[at])
    lang, source = (pa.array([g[i] for g in names], pa.binary()).cast(pa.string()).take(which) for i in (0, 1))
    whole = pa.RecordBatch.from_arrays([lang, terms, source, pa.array(np.full(len(at), block)), pa.array(docs), pa.array(n)], ["lang", "term", "source", "block", "docs", "n"])
    for i in range(0, len(at), ROWS):
        yield whole.slice(i, ROWS)


def _cut(text: bytes):
    """A long text in pieces that end between terms."""
    folded, at = text.translate(_FOLD), 0
    while len(folded) - at > BLOCK:
        end = folded.rfind(b" ", at, at + BLOCK)
        end = folded.find(b" ", at + BLOCK) if end < 0 else end
        if end < 0:
            break
        yield folded[at:end]
        at = end + 1
    yield folded[at:]


def _scan_documents(batches):
    texts, groups, size, block = [], [], 0, TaskContext.get().partitionId() << 32
    for batch in parts(batches):
        for lang, source, text in zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns), strict=True):
            if len(text) > BLOCK:
                seen: set = set()
                for piece in _cut(text):
                    yield from _records([piece], [(lang, source)], block, seen)
                    block += 1
                continue
            texts.append(text)
            groups.append((lang, source))
            size += len(text)
            if size >= BLOCK:
                yield from _records(texts, groups, block)
                texts, groups, size, block = [], [], 0, block + 1
    yield from _records(texts, groups, block)


def _edges(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Where a row differs from the one before in its first ``keys`` columns; none of them is null."""
    out = np.ones(batch.num_rows, bool)
    out[1:] = False
    for c in batch.columns[:keys]:
        out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def _full(batches):
    return (b for b in batches if b.num_rows)


def _one_batch(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _scan_runs(batches):
    """Sums of each run of equal (lang, term, source), and of the (lang, term) it belongs to; the last term of a batch waits for the next."""
    rest: pa.RecordBatch | None = None
    for batch in _full(batches):
        rows = batch if rest is None else _one_batch([rest, batch])
        last = int(np.flatnonzero(_edges(rows, 2))[-1])
        if last:
            yield _summed(rows[:last])
        rest = _sources(rows[last:])
    if rest is not None:
        yield _summed(rest)


def _sources(rows: pa.RecordBatch) -> pa.RecordBatch:
    first = np.flatnonzero(_edges(rows, 3))
    salt, docs, n = (rows.column(i).to_numpy() for i in (3, 4, 5))
    sums = [np.maximum.reduceat(salt, first), np.add.reduceat(docs, first), np.add.reduceat(n, first)]
    return pa.RecordBatch.from_arrays([*(c.take(pa.array(first)) for c in rows.columns[:3]), *map(pa.array, sums)], rows.schema.names)


def _summed(rows: pa.RecordBatch) -> pa.RecordBatch:
    rows = _sources(rows)
    edge = _edges(rows, 2)
    first, of = np.flatnonzero(edge), np.cumsum(edge) - 1
    salt, docs, n = (rows.column(i).to_numpy() for i in (3, 4, 5))
    of_term = [np.maximum.reduceat(salt, first)[of] > 0, np.add.reduceat(docs, first)[of], np.add.reduceat(n, first)[of], edge.astype(np.int64)]
    return pa.RecordBatch.from_arrays([*rows.columns[:3], *rows.columns[4:], *map(pa.array, of_term)], ["lang", "term", "source", "docs", "n", "split", "all_docs", "all_n", "one"])


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _square(pa_: np.ndarray, za: np.ndarray, pb: np.ndarray, zb: np.ndarray) -> np.ndarray:
    """For each source of a and of b, the sum over terms (rows) of what both having the term adds."""
    out = np.zeros((len(za), len(zb)), np.int64)
    step = max(1, (1 << 20) // max(1, len(za) * len(zb)))
    a0, b0 = za[None, :, None], zb[None, None, :]
    for i in range(0, len(pa_), step):
        a, b = pa_[i : i + step, :, None], pb[i : i + step, None, :]
        out += (_gap(a, b) - _gap(a, b0) - _gap(a0, b) + _gap(a0, b0)).sum(0)
    return out


def _compare(term: np.ndarray, source: np.ndarray, p: np.ndarray, z: np.ndarray, side: int):
    """(source a, source b, sum) of sources, a < b, that share one of these terms. Arrays go by term, then source."""
    ids, at, place = np.unique(source, return_index=True, return_inverse=True)
    terms = np.unique(term, return_inverse=True)[1]
    count = int(terms[-1]) + 1
    if len(ids) > side and count > 1:  # fewer terms have fewer sources
        half = int(np.searchsorted(terms, count // 2))
        for part in (slice(None, half), slice(half, None)):
            yield from _compare(term[part], source[part], p[part], z[part], side)
        return
    zs = z[at]
    shares = np.broadcast_to(zs, (count, len(ids))).copy()
    shares[terms, place] = p
    for i in range(0, len(ids), side):
        for j in range(i, len(ids), side):
            x = _square(shares[:, i : i + side], zs[i : i + side], shares[:, j : j + side], zs[j : j + side])
            for a, b in zip(*np.nonzero(np.triu(x, 1) if i == j else x), strict=True):
                yield ids[i + a], ids[j + b], int(x[a, b])


def _scan_pairs(batches, side: int):
    """Partial sums of pairs from rows (lang, term, source, p, z) in that order, all rows of a term in one partition."""
    found: Counter = Counter()
    rest: pa.Table | None = None

    def out():
        keys = list(found)
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([found[k] for k in keys], pa.int64())], ["lang", "a", "b", "x"])
        found.clear()

    def compare(rows: pa.RecordBatch, starts: np.ndarray):
        """Terms of one language at a time."""
        number = np.cumsum(np.isin(np.arange(rows.num_rows), starts))
        langs = np.append(np.flatnonzero(_edges(rows, 1)), rows.num_rows)
        source = np.array(rows.column(2).to_pylist(), object)
        p, z = rows.column(3).to_numpy(), rows.column(4).to_numpy()
        for s, e in zip(langs, langs[1:], strict=False):
            lang = rows.column(0)[int(s)].as_py()
            for a, b, x in _compare(number[s:e], source[s:e], p[s:e], z[s:e], side):
                found[lang, a, b] += x

    for batch in _full(batches):
        rows = batch if rest is None else _one_batch([rest, batch])
        starts = np.flatnonzero(_edges(rows, 2))
        last = int(starts[-1])
        if last:
            compare(rows[:last], starts[:-1])
        rest = rows[last:]
        if len(found) > 4 * side * side:
            yield from out()
    if rest is not None and rest.num_rows:
        compare(rest, np.array([0]))
    yield from out()


def term_counts(documents: DataFrame, min_documents: int) -> DataFrame:
    """``(lang, term, source, n, all_n, one)`` of the kept terms: how often a (lang, source) has a term, how often its lang,
    and 1 in one row of each (lang, term), else 0."""
    text = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    order = ["lang", "term", "source"]
    # A record of many documents goes to one of several places by its block.
    salt = F.when(F.col("docs") >= FREQUENT, 1 + F.pmod(F.xxhash64("block"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    records = text.mapInArrow(_scan_documents, _RECORD).withColumn("salt", salt)
    # Rows are dealt by term, so that one scan sees all its sources. The hash decides most comparisons of the sort; it is made on either side.
    dealt = records.repartition("lang", "term", "salt").sortWithinPartitions(F.xxhash64("lang", "term"), *order, "block")
    runs = materialize(dealt.select(*order, "salt", "docs", "n").mapInArrow(_scan_runs, _RUN), "runs")
    # Terms with a salted record may stand in several partitions; all others are whole.
    split = runs.where("split").select("lang", "term").distinct()
    split = materialize(split.withColumn("spread", F.lit(True)), "split")
    split = F.broadcast(split) if split.count() <= FEW_TERMS else split
    runs = runs.join(split, ["lang", "term"], "left")
    whole = runs.where(F.col("spread").isNull() & (F.col("all_docs") >= min_documents)).select(*order, "n", "all_n", "one")
    rows = runs.where("spread")
    totals = rows.groupBy("lang", "term").agg(F.sum("docs").alias("all_docs"), F.sum("n").alias("all_n"), F.min("source").alias("first")).where(F.col("all_docs") >= min_documents)
    spread = rows.groupBy(*order).agg(F.sum("n").alias("n")).join(totals, ["lang", "term"])
    return whole.unionByName(spread.select(*order, "n", "all_n", (F.col("source") == F.col("first")).cast("long").alias("one")))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact; null where no term is kept."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    bottom = F.nullif(wide(total + 2 * terms, 38), wide(F.lit(0), 38))
    return _div(wide(wide(count + 2, 27) * wide(F.lit(SCALE), 10), 38), bottom) + 1


def _f(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def audit(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP, side: int = SIDE) -> DataFrame:
    """The digest of ``op13``: ``(lang, source, part, item, value, rank)``.

    Null text, lang and source are empty strings. Each row is a document, so repeated rows and repeated or null doc_ids
    count as often as they stand there. Texts of any length are read whole, in pieces. Ties rank by item. A lang whose
    documents keep no term gives pairs of value 0. An empty table gives no row. Other columns are not read.
    """
    of_group = W.partitionBy("lang", "source")
    kept = materialize(term_counts(documents, min_documents), "terms")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("one").alias("terms"))
    every = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = every.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("own")), ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("group_n", "own", "lang_n", "terms")))
    groups = materialize(groups.withColumn("z", _share(zero, F.col("group_n"), F.col("terms"))), "groups")

    shares = kept.join(groups, ["lang", "source"]).select("lang", "term", "source", _share(F.col("n"), F.col("group_n"), F.col("terms")).alias("p"), "z", _share(F.col("all_n"), F.col("lang_n"), F.col("terms")).alias("q"))
    shares = materialize(shares, "shares")
    listed = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    by_value = of_group.orderBy(F.desc("value"), "item")
    listed = listed.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    ordered = shares.select("lang", "term", "source", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    shared = ordered.mapInArrow(partial(_scan_pairs, side=side), _PAIR).groupBy("lang", "a", "b").agg(F.sum("x").alias("x"))
    shared = shared.unionByName(shared.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "x"))
    # What a source's own terms give against each share that an absent term can have in its language.
    against = groups.select("lang", F.col("z").alias("other_z")).distinct()
    own = shares.groupBy("lang", "source", "p").count().join(against, "lang").groupBy("lang", "source", "other_z").agg(F.sum(F.col("count") * _f(F.col("p"), F.col("other_z"))).alias("held"))
    one = groups.select("lang", F.col("source").alias("a"), F.col("z").alias("za"), F.col("own").alias("own_a"), "terms")
    two = groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"), F.col("own").alias("own_b"))
    pairs = (
        one.join(two, "lang").where("a <> b")
        .join(own.select("lang", F.col("source").alias("a"), F.col("other_z").alias("zb"), F.col("held").alias("held_a")), ["lang", "a", "zb"], "left")
        .join(own.select("lang", F.col("source").alias("b"), F.col("other_z").alias("za"), F.col("held").alias("held_b")), ["lang", "b", "za"], "left")
        .join(shared, ["lang", "a", "b"], "left")
    )
    neither = (F.col("terms") - F.col("own_a") - F.col("own_b")) * _f(F.col("za"), F.col("zb"))
    value = F.when(F.col("terms") == 0, zero).otherwise(F.coalesce("x", zero) + F.coalesce("held_a", zero) + F.coalesce("held_b", zero) + neither)
    pairs = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    parts_ = [rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for rows, name in ((pairs, "pair"), (listed, "term"))]
    return parts_[0].unionByName(parts_[1])
