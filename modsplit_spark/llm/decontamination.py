"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

The CGK random walk reads a word sequence while writing three times as many places: at each step it
writes the word it stands on and moves on or stays by a random bit that depends on step and word.
Two sequences a few edits apart soon walk in step again, so their edit distance shows as a Hamming
distance. ``WALKS`` walks, each sampled at ``SAMPLES`` sets of ``PLACES`` places, give the keys of the LSH
tables; an item-sized window of a document that shares a key with an item of its length is a
candidate, and an alignment of the item with that part of the document decides.

Which windows are worth embedding is settled first, without loss: an item of L words within d edits
shares at least L - q + 1 - q d of its q-word shingles with the place it stands in, so only windows
about so many shared shingles of one item are embedded, with lengths of such items.

Items are distinct texts of any length (those of under five words allow no edit); ids come back by a join at the end. They travel
to the tasks in blocks of at most ``ITEMS_PER_BLOCK`` items and about ``BLOCK_BYTES`` of text. The driver holds one block at a time: each is one pass
over the documents, whose findings are written before the next.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modsplit_spark.llm.bytegrams import parts
from modsplit_spark.llm.wordhash import mix, word_hashes
from modsplit_spark.sources.workspace import materialize

SIMILARITY = 0.8
WALKS, SAMPLES, PLACES = 8, 8, 3
ITEMS_PER_BLOCK, BLOCK_BYTES = 20_000, 16 << 20
#: Rows of a benchmark up to which its ids are broadcast to the findings; a larger one is joined by shuffle.
BROADCAST_ITEMS = 50_000
HASHED_BYTES, CHUNK_BYTES = 1 << 20, 8 << 20
SEED = 77
#: ASCII marks count as blanks.
MARKS = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


def _prepared(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def edits(length: int, similarity: float = SIMILARITY) -> int:
    """Most word edits that leave an item of ``length`` words at ``similarity`` or more (1 - edits / length)."""
    return math.floor((1 - similarity) * length + 1e-9)


def shingle_size(length: int, d: int) -> int:
    """The longest shingle, up to three words, of which at least two must survive ``d`` edits."""
    return next((q for q in (3, 2) if length - q + 1 - q * d >= 2), 1)


def shingles(words: np.ndarray, q: int) -> np.ndarray:
    h = np.zeros(max(0, len(words) - q + 1), np.uint64)
    for k in range(q):
        h = mix(h ^ words[k : k + len(h)]) if k else words[: len(h)].copy()
    return h


def walk_keys(windows: np.ndarray) -> np.ndarray:
    """LSH keys (tables x windows) of equally long word sequences, one a row."""
    n, length = windows.shape
    rng = np.random.default_rng(SEED + length)
    flat = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1).ravel()
    begin, out = np.arange(n) * (length + 1), []
    end = begin + length
    for walk in range(WALKS):
        places = rng.integers(0, 3 * length, (SAMPLES, PLACES))
        salts = rng.integers(0, 1 << 62, 3 * length).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        keys = np.full((SAMPLES, n), walk + 1, np.uint64)
        at = begin
        wanted: dict[int, list[tuple[int, int]]] = {}
        for i, j in np.ndindex(places.shape):
            wanted.setdefault(int(places[i, j]), []).append((i, j))
        for step in range(max(wanted) + 1):
            word = flat[at]
            for i, j in wanted.get(step, ()):
                keys[i] += mix(word ^ np.uint64(0x51ED270B * (j + 1)))
            # The walk moves by the top bit of a product of the word and the step's odd number, up to the blank at the end.
            at = np.minimum(at + (word * salts[step] >> np.uint64(63)).astype(np.int64), end)
        out.append(mix(keys + np.arange(SAMPLES, dtype=np.uint64)[:, None]))
    return np.concatenate(out)


class Index:
    """The shingles and LSH tables of a block of items."""

    def __init__(self, items: list[tuple[object, str | None]], similarity: float = SIMILARITY):
        words, owner, *_ = word_hashes([_prepared(t) for _, t in items] or [b""], MARKS)
        bounds = np.searchsorted(owner, np.arange(len(items) + 1))
        self.ids, self.words = [], []
        for (item, _), a, b in zip(items, bounds, bounds[1:], strict=False):
            if b > a:
                self.ids.append(item)
                self.words.append(words[a:b])
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.array([edits(n, similarity) for n in self.length], np.int64)
        self.q = np.array([shingle_size(n, d) for n, d in zip(self.length, self.edits, strict=True)], np.int64)
        self.need = np.maximum(1, self.length - self.q + 1 - self.q * self.edits)
        self.by_size = {}
        for q in sorted(set(self.q.tolist())):
            pairs = [(h, t) for t in np.flatnonzero(self.q == q) for h in np.unique(shingles(self.words[t], q)).tolist()]
            h = np.array([p[0] for p in pairs], np.uint64)
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 22, bool)
            seen[h >> np.uint64(42)] = True
            self.by_size[q] = (h[order], np.array([p[1] for p in pairs], np.int64)[order], seen)
        self.tables = {}
        for n in sorted(set(self.length.tolist())):
            of = np.flatnonzero(self.length == n)
            keys = walk_keys(np.stack([self.words[t] for t in of]))
            flat, item = keys.ravel(), np.tile(of, len(keys))
            order = np.argsort(flat, kind="stable")
            self.tables[n] = (flat[order], item[order])


def _matches(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (index of key, index in ``sorted_keys``) with equal values."""
    lo, hi = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
    count = hi - lo
    of = np.repeat(np.arange(len(keys)), count)
    return of, np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())


def shared_places(words: np.ndarray, owner: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(item, word) where enough of the item's shingles follow, the first of them at ``word``."""
    found = []
    for q, (hashes, items, seen) in index.by_size.items():
        h = shingles(words, q)
        if not len(h):
            continue
        at = np.flatnonzero(seen[h >> np.uint64(42)] & (owner[: len(h)] == owner[q - 1 :]))
        of, where = _matches(hashes, h[at])
        at, item = at[of], items[where]
        order = np.lexsort((at, item))
        at, item = at[order], item[order]
        last = np.arange(len(at)) + index.need[item] - 1
        ok = last < len(at)
        k, last = np.flatnonzero(ok), last[ok]
        span = index.length[item[k]] + index.edits[item[k]] - q
        good = (item[last] == item[k]) & (owner[at[last]] == owner[at[k]]) & (at[last] - at[k] <= span)
        found.append((item[k[good]], at[k[good]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def lsh_candidates(words: np.ndarray, owner: np.ndarray, bounds: np.ndarray, index: Index) -> list[tuple[int, int]]:
    """Distinct (item, first word of an item-sized window) that share a key of some LSH table."""
    item, at = shared_places(words, owner, index)
    if not len(item):
        return []
    out = []
    length, back = index.length[item], (index.q[item] + 1) * index.edits[item]
    for n in np.unique(length).tolist():
        of = length == n
        reach = np.repeat(at[of] - back[of], back[of] + 1)
        start = reach + (np.arange(len(reach)) - np.repeat(np.cumsum(back[of] + 1) - (back[of] + 1), back[of] + 1))
        text = np.repeat(owner[at[of]], back[of] + 1)
        # A window stays within its text; one that can't holds what there is.
        start = np.maximum(np.minimum(start, bounds[text + 1] - n), bounds[text])
        start, keep = np.unique(start, return_index=True)
        text = text[keep]
        place = start[:, None] + np.arange(n)
        inside = place < bounds[text + 1][:, None]
        window = np.where(inside, words[np.minimum(place, len(words) - 1)], np.uint64(0))
        keys, items = index.tables[n]
        table = walk_keys(window)
        column, where = _matches(keys, table.ravel())
        pairs = np.unique(items[where] * np.int64(len(words)) + start[column % len(start)])
        out += [divmod(p, len(words)) for p in pairs.tolist()]
    return out


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least word edit distance of ``item`` to any stretch of ``text``, and that stretch (the leftmost such start)."""
    edit, n = 1 << 32, len(text)
    steps = np.arange(n + 1, dtype=np.int64) * edit
    row = np.arange(n + 1, dtype=np.int64)  # distance and start in one number
    for word in item:
        new = row + edit
        np.minimum(new[1:], row[:-1] + np.where(text == word, 0, edit), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end] // edit), int(row[end] % edit), end


def occurrences(item: np.ndarray, most: int, text: np.ndarray, base: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) of stretches of ``text`` within ``most`` edits that do not overlap, best first and then on either side."""
    # Every word of the item that the text lacks costs an edit.
    if len(text) < len(item) - most or np.count_nonzero(np.isin(item, text)) < len(item) - most:
        return []
    distance, start, end = align(item, text)
    if distance > most:
        return []
    left, right = occurrences(item, most, text[:start], base), occurrences(item, most, text[end:], base + end)
    return [*left, (base + start, base + end, distance), *right]


def leaks(texts: list[bytes], index: Index) -> list[tuple[int, object, int, int, int, int]]:
    """(text, item id, first word in its text, words, edits, words of the item) for every leak in a chunk."""
    parts, first, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= HASHED_BYTES or i == len(texts) - 1:
            words, owner, *_ = word_hashes(texts[first : i + 1], MARKS)
            parts.append((words, owner + first))
            first, size = i + 1, 0
    words, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    regions: dict[tuple[int, int], list[list[int]]] = {}
    for item, start in sorted(lsh_candidates(words, owner, bounds, index)):
        n, d, text = int(index.length[item]), int(index.edits[item]), int(owner[start])
        lo, hi = max(int(bounds[text]), start - 2 * d), min(int(bounds[text + 1]), start + n + 2 * d)
        held = regions.setdefault((text, item), [])
        if held and lo <= held[-1][1]:
            held[-1][1] = max(held[-1][1], hi)
        else:
            held.append([lo, hi])
    out = []
    for (text, item), spans in sorted(regions.items()):
        for lo, hi in spans:
            for a, b, distance in occurrences(index.words[item], int(index.edits[item]), words[lo:hi], lo):
                out.append((text, index.ids[item], a - int(bounds[text]), b - a, distance, int(index.length[item])))
    return out


def _found(batches, index: Index):
    for batch in parts(batches, 2048):
        texts, start = [_prepared(t) for t in batch.column(1).to_pylist()], 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK_BYTES):
                size += len(texts[end])
                end += 1
            rows = leaks(texts[start:end], index)
            if rows:
                text, item, at, n, distance, length = zip(*rows, strict=True)
                similarity = [1 - d / k for d, k in zip(distance, length, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([start + t for t in text])), pa.array(item, pa.string()), *(pa.array(x, pa.int64()) for x in (at, n, distance)), pa.array(similarity)],
                    ["doc_id", "item", "start_word", "n_words", "edits", "similarity"],
                )
            start = end


def find_leaks(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """``(doc_id, item_id, start_word, n_words, edits, similarity)``, one row for each stretch of a document that is a
    benchmark item with at most ``(1 - similarity) * words of the item`` words inserted, lost or replaced.

    Words are lower-cased runs without white space and ASCII marks. Null and empty texts, and items without a word, give no row;
    items of under five words must stand there word by word. Repeated rows of either table count as often as they occur; an
    empty table on either side gives no row. Stretches of one item do not overlap. Other columns are not read; doc_id may be of any type."""
    ids = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").select("item_id", "text", F.md5(F.col("text").cast("binary")).alias("item"))
    items = ids.groupBy("item").agg(F.first("text").alias("text"))
    count, size = items.agg(F.count("*"), F.sum(F.length("text"))).first()
    blocks = max(1, -(-count // items_per_block), -(-(size or 0) // BLOCK_BYTES))
    if blocks > 1:
        items = materialize(items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")).repartition("block"), "benchmark-blocks")
    schema = T.StructType([documents.schema["doc_id"], *(T.StructField(n, k) for n, k in (("item", T.StringType()), ("start_word", T.LongType()), ("n_words", T.LongType()), ("edits", T.LongType()), ("similarity", T.DoubleType())))])
    found = None
    for block in range(blocks):
        own = items.where(F.col("block") == block) if blocks > 1 else items
        index = Index([tuple(r) for r in own.select("item", "text").collect()], similarity)
        part = documents.select("doc_id", F.col("text").cast("string")).mapInArrow(partial(_found, index=index), schema)
        if blocks > 1:
            part = materialize(part, "leaks")
        found = part if found is None else found.unionByName(part)
    known = ids.select("item_id", "item")
    if benchmark.count() <= BROADCAST_ITEMS:
        known = F.broadcast(known)
    return found.join(known, "item").select("doc_id", "item_id", "start_word", "n_words", "edits", "similarity")
