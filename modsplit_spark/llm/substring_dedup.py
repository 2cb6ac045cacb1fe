"""Substring dedup by recompression: words covered by a passage that also starts earlier are removed.

Recompression names neighbouring symbols round by round. First each run of one word becomes one symbol, named by word and length.
Then symbols fall into two classes by a bit of their name, and each adjacent pair (first class, second class) becomes one
symbol. Each round is a Spark job over all texts: it counts, for every candidate bit, the pairs that bit would join in the
whole table, and the bit that joins most is the partition of that round. Names are 64-bit hashes of what they stand for, so that
all tasks give equal content the same name without a shared dictionary. Whether two neighbours merge depends on them
alone; so of equal passages all symbols are equal but those of a few runs from either end. Two rounds give symbols of at most four runs; a window of 20 words
holds some within the part where equal windows must agree. (After a third, with symbols of eight, it need not hold any.) A symbol's last name is
taken from its words and the ``EDGE`` words on either side, which every window that it can stand for holds. The longest
symbol in bytes, and of equally long ones that with the least name, is the window's anchor.

Consecutive windows with one anchor make a segment, the highest symbol: about 25 words for six windows. Spark gathers
segments by anchor name: a name that occurs once holds no repeat. Where all segments of a name have the same
content, the first in document order stays and the others go. Where contents differ, the windows of each
content's first segment are compared one by one by 128-bit hashes; so are windows that a word or short period repeated leaves without an anchor. Nothing is sampled: the result is exact but
for collisions of those hashes (name and content of a segment make 122 bits; words themselves are not compared).

Tasks work through their texts in chunks of about ``CHUNK_BYTES``. What repeats within a chunk is settled
there, and what a task has announced shortly before is not announced again (``Seen``), so that a name or window reaches Spark's shuffle a few times
a task, however common it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modsplit_spark.llm.bytegrams import parts
from modsplit_spark.llm.wordhash import BASES, mix, range_hash, range_sums, word_hashes
from modsplit_spark.sources.workspace import materialize

WINDOW = 20
CHUNK_BYTES = 3 << 20
#: Runs at either end of a window where equal windows may be parsed differently, and so words on either side that all its symbols have.
EDGE = 4
INSIDE = WINDOW - 2 * EDGE
ROUNDS = 2
#: Bits of a name that may part the symbols of a round.
CANDIDATES = range(17, 33)
#: Announced segments or windows that a task remembers.
SEEN = 1 << 18
SINGLE, MARK, OPEN, GONE = 0, 1, 2, 3
KEY = ["doc", "crc", "hash"]
KEY_TYPE = ", ".join(f"{k} long" for k in KEY)


class Runs:
    """The runs of equal words of a chunk: names, first words, and the text they belong to."""

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        n = len(words)
        new = np.concatenate([[True], (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])]) if n else np.zeros(0, bool)
        self.of = np.cumsum(new) - 1
        self.start = np.append(np.flatnonzero(new), n)
        size = np.diff(self.start)
        word = words[self.start[:-1]]
        self.name = np.where(size > 1, mix(word * np.uint64(BASES[2]) ^ size.astype(np.uint64)), word)
        self.owner = owner[self.start[:-1]]


def joins(name: np.ndarray, owner: np.ndarray, bit: int) -> np.ndarray:
    """For each symbol whether it becomes one with the next: neighbours of one text, the bit unset in the first and set in the second."""
    high = (name >> np.uint64(bit)) & np.uint64(1) == 1
    return np.append(~high[:-1] & high[1:] & (owner[:-1] == owner[1:]), False)[: len(name)]


def recompress(name: np.ndarray, owner: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, first runs and texts of the symbols after a round for each of ``bits``."""
    start = np.arange(len(name))
    for level, bit in enumerate(bits):
        first = joins(name, owner, bit)
        second = np.concatenate([[False], first[:-1]])[: len(name)]
        at = np.flatnonzero(first)
        name = name.copy()
        name[at] = mix(name[at] * np.uint64(BASES[1]) + name[at + 1] + np.uint64(level))
        name, start, owner = name[~second], start[~second], owner[~second]
    return name, start, owner


def _pairs(batches, bits: list[int]):
    """For each candidate bit, the pairs that it would join after the rounds of ``bits``."""
    counts = np.zeros(len(CANDIDATES), np.int64)
    for rows in _chunks(batches):
        words, owner, *_ = word_hashes([r[3] for r in rows])
        runs = Runs(words, owner)
        name, _, of = recompress(runs.name, runs.owner, bits)
        counts += [int(joins(name, of, bit).sum()) for bit in CANDIDATES]
    yield pa.RecordBatch.from_arrays([pa.array(list(CANDIDATES), pa.int32()), pa.array(counts)], ["bit", "n"])


def partitions(texts: DataFrame, rounds: int = ROUNDS) -> list[int]:
    """The bit that parts the symbols of each round: of all candidates the one that joins the most pairs of the whole table."""
    bits: list[int] = []
    for _ in range(rounds):
        counted = texts.mapInArrow(partial(_pairs, bits=list(bits)), "bit int, n long").groupBy("bit").agg(F.sum("n").alias("n"))
        best = counted.agg(F.max_by("bit", F.struct("n", "bit"))).first()[0]
        bits.append(CANDIDATES[0] if best is None else best)
    return bits


def anchors(words: np.ndarray, owner: np.ndarray, word_bytes: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every word its anchor's name as the start of a window (of it and 19 more words of its text); whether it
    starts one; whether that has an anchor; and the names that recur so closely that a segment may hold equal windows."""
    n = len(words)
    valid = np.zeros(n, bool)
    if n >= WINDOW:
        valid[: n - WINDOW + 1] = owner[: n - WINDOW + 1] == owner[WINDOW - 1 :]
    if not valid.any():
        return np.zeros(n, np.uint64), valid, valid, np.zeros(0, np.uint64)
    runs = Runs(words, owner)
    _, first, _ = recompress(runs.name, runs.owner, bits)
    begin, end = runs.start[first], runs.start[np.append(first[1:], len(runs.name))]
    total = np.concatenate([[0], np.cumsum(word_bytes)])
    # The last name, with the words on either side; symbols nearer to an end of the chunk are no anchors.
    name = range_hash(range_sums(words, BASES[2]), np.maximum(begin - EDGE, 0), np.minimum(end + EDGE, n), BASES[2])
    # Long symbols come first, as they recur less by chance: the top bits hold what a symbol lacks of 63 bytes.
    lack = 63 - np.minimum(63, total[end] - total[begin])
    name = (name >> np.uint64(6)) | (lack.astype(np.uint64) << np.uint64(58))
    # Symbols that begin EDGE runs after the window's first and end EDGE runs before its last.
    begun = np.cumsum(np.bincount(first, minlength=len(runs.name)))
    at = np.flatnonzero(valid)
    top = len(begun) - 1
    lo = begun[np.minimum(runs.of[at] + EDGE - 1, top)]
    hi = begun[np.maximum(runs.of[at + WINDOW - 1] - EDGE + 1, 0)] - 2
    some = hi >= lo
    at, lo, hi = at[some], lo[some], hi[some]
    level = np.frexp(hi - lo + 1)[1] - 1
    least, table = np.zeros(n, np.uint64), name
    for k in range(int(level.max(initial=0)) + 1):
        of = level == k
        least[at[of]] = np.minimum(table[lo[of]], table[hi[of] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    anchored = np.zeros(n, bool)
    anchored[at] = True
    close = [name[:-k][(name[:-k] == name[k:]) & (begin[k:] - begin[:-k] <= WINDOW)] for k in range(1, INSIDE + 1) if k < len(name)]
    return least, valid, anchored, np.unique(np.concatenate(close)) if close else np.zeros(0, np.uint64)


def segments(texts: list[bytes], bits: list[int]) -> dict[str, np.ndarray]:
    """All segments of a chunk in document order, each with its anchor name, content hash, text, first window
    (counted in its text), number of windows, whether its windows must be compared one by one, and whether it has an anchor."""
    words, owner, begin, stop, _ = word_hashes(texts)
    least, valid, anchored, close = anchors(words, owner, stop - begin, bits)
    n = len(words)
    goes_on = np.zeros(n, bool)
    if n:
        goes_on[1:] = valid[1:] & valid[:-1] & (anchored[1:] == anchored[:-1]) & (least[1:] == least[:-1]) & (owner[1:] == owner[:-1])
    first = np.flatnonzero(valid & ~goes_on)
    ends = np.flatnonzero(valid & ~np.append(goes_on[1:], False)[:n]) + 1
    content = range_hash(range_sums(words, BASES[1]), first, ends + WINDOW - 1, BASES[1])
    text_first = np.searchsorted(owner, np.arange(len(texts)))
    name = least[first]
    odd = (ends - first > INSIDE) | np.isin(name, close)
    return {"name": name, "content": content, "text": owner[first], "at": first - text_first[owner[first]], "size": ends - first, "odd": odd, "anchored": anchored[first]}


def settle(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, kind) for a chunk's segments, and the names to announce as having several contents."""
    n = len(s["name"])
    order = np.lexsort((np.arange(n), s["content"], s["name"]))
    name, content, anchored = s["name"][order], s["content"][order], s["anchored"][order]
    new_name = np.concatenate([[True], name[1:] != name[:-1]]) if n else np.zeros(0, bool)
    new_content = new_name | np.concatenate([[True], content[1:] != content[:-1]]) if n else new_name
    group = np.cumsum(new_name) - 1
    several = (np.bincount(group, new_content) > 1) | (np.bincount(group, s["odd"][order]) > 0) if n else np.zeros(0, bool)
    kind = np.where(~anchored, OPEN, np.where(~new_content, GONE, np.where(several[group], OPEN, SINGLE))) if n else np.zeros(0, np.int64)
    return order, kind, name[new_name & anchored][several[anchored[new_name]]] if n else name


class Seen:
    """What a task has announced lately: pairs of numbers and the places of their earliest announcement, one for each of ``SEEN``
    cells."""

    def __init__(self):
        self.held = None

    def earlier(self, a: np.ndarray, b: np.ndarray, place: tuple[np.ndarray, ...]) -> np.ndarray:
        """Whether the same pair stands in its cell with an earlier place; the others are written. Pairs are distinct."""
        if self.held is None:
            self.held = np.zeros((2 + len(place), SEEN), np.int64)
        cell = (a % np.uint64(SEEN)).astype(np.int64)
        own = np.stack([a.view(np.int64), b.view(np.int64), *place])
        there = self.held[:, cell]
        same = (there[0] == own[0]) & (there[1] == own[1])
        before, tied = np.zeros(len(a), bool), same.copy()
        for x, y in zip(there[2:], own[2:], strict=True):
            before |= tied & (x < y)
            tied &= x == y
        new = np.flatnonzero(~before)
        cells, one = np.unique(cell[new], return_index=True)
        self.held[:, cells] = own[:, new[one]]
        return before


def _chunks(batches) -> Iterator[list[tuple]]:
    """Rows (doc, crc, hash, text, starts, sizes or nothing) in chunks of about CHUNK_BYTES, in document order, equal rows once."""
    held, size = {}, 0
    for batch in parts(batches):
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            key = row[:3]
            if key in held:
                continue
            text = row[3].encode("utf-8", "surrogatepass")
            held[key] = (*key, text, *row[4:])
            size += len(text)
            if size >= CHUNK_BYTES:
                yield [held[k] for k in sorted(held)]
                held, size = {}, 0
    if held:
        yield [held[k] for k in sorted(held)]


def _keys(rows: list[tuple], text: np.ndarray) -> list[np.ndarray]:
    return [np.array([r[i] for r in rows], np.int64)[text] for i in range(len(KEY))]


def _own(at: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Numbers that stand for places, so that what is settled does not meet in one task."""
    h = at.astype(np.uint64)
    for k in keys:
        h = mix(h * np.uint64(BASES[0]) + k.view(np.uint64))
    return h | np.uint64(1 << 63)


def _first_pass(batches, bits: list[int]):
    seen = Seen()
    for rows in _chunks(batches):
        s = segments([r[3] for r in rows], bits)
        order, kind, several = settle(s)
        text, at, size, name, content = (s[c][order] for c in ("text", "at", "size", "name", "content"))
        keys = _keys(rows, text)
        new = np.flatnonzero((kind == SINGLE) | ((kind == OPEN) & s["anchored"][order]))
        again = seen.earlier(name[new], content[new], (*(k[new] for k in keys), at[new]))
        kind[new[again]] = GONE
        none = np.zeros(len(several), np.int64)
        columns = [
            np.concatenate([kind, np.full(len(several), MARK)]).astype(np.int8),
            np.concatenate([np.where(kind == SINGLE, name, _own(at, keys)), several]).view(np.int64),
            np.concatenate([content.view(np.int64), none]),
            *(np.concatenate([x, none]) for x in (*keys, at, size)),
        ]
        yield from pa.table([pa.array(c) for c in columns], ["kind", "name", "content", *KEY, "at", "size"]).to_batches(1 << 16)


def _second_pass(batches):
    """Windows of open segments as 128-bit hashes; those with an earlier equal in the chunk are gone at once."""
    seen = Seen()
    for rows in _chunks(batches):
        words, owner, *_ = word_hashes([r[3] for r in rows])
        text_first = np.searchsorted(owner, np.arange(len(rows)))
        at = []
        for first, (*_, starts, sizes) in zip(text_first.tolist(), rows, strict=True):
            start, size = np.array(starts, np.int64), np.array(sizes, np.int64)
            at.append(np.unique(first + np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())))
        at = np.concatenate(at)
        a, b = (range_hash(range_sums(words, base), at, at + WINDOW, base) for base in BASES[1:])
        order = np.lexsort((at, b, a))
        again = np.concatenate([[False], (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])])
        gone = np.zeros(len(at), bool)
        gone[order[again]] = True
        new = np.flatnonzero(~gone)
        text = owner[at[new]]
        gone[new[seen.earlier(a[new], b[new], (*_keys(rows, text), at[new] - text_first[text]))]] = True
        # Neighbouring settled windows leave as one run.
        head = ~gone | np.concatenate([[True], ~gone[:-1] | (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
        size = np.diff(np.append(np.flatnonzero(head), len(at)))
        at, a, b, gone = at[head], a[head], b[head], gone[head]
        text = owner[at]
        keys, at = _keys(rows, text), at - text_first[text]
        a, b = np.where(gone, _own(at, keys), a).view(np.int64), np.where(gone, np.uint64(0), b).view(np.int64)
        yield from pa.table([pa.array(x) for x in (gone, a, b, *keys, at, size)], ["gone", "a", "b", *KEY, "at", "size"]).to_batches(1 << 16)


def _kept(text: str | None, starts: list[int] | None, sizes: list[int] | None) -> tuple[int, int, bytes]:
    """Number of words, of removed ones, and the kept words joined by blanks."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not starts:
        return n, 0, b" ".join(words)
    at, size = np.array(starts, np.int64), np.array(sizes, np.int64)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size + WINDOW - 1, -1)
    keep = np.cumsum(edge[:n]) == 0
    return n, n - int(keep.sum()), b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def _digest(batches):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    for batch in parts(batches):
        out = []
        for text, starts, sizes in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            n, gone, kept = _kept(text, starts, sizes)
            out.append((n, gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if gone else text))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)


def _without_text(batches):
    for batch in _digest(batches):
        yield batch.select(["doc_id", "n_words", "n_removed", "kept_sha256"])


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """``doc``, ``crc`` and ``hash``: documents in order. Null ids, and ids that are no integer, come first; rows of one id
    come by two hashes of their text, which are equal for equal texts alone."""
    return [F.coalesce(doc_id.try_cast("long"), F.lit(-(1 << 63))).alias("doc"), F.coalesce(F.crc32(text.cast("binary")), F.lit(-1)).alias("crc"), F.xxhash64(text).alias("hash")]


def removed_places(texts: DataFrame) -> DataFrame:
    """``(doc, crc, hash, starts, sizes)``: of each text with repeats, the starts and lengths of runs of windows that go.

    ``texts`` has doc, crc and hash (longs, none null) and text."""
    some = texts.where("text is not null").select(*KEY, "text")
    bits = partitions(some)
    segs = some.mapInArrow(partial(_first_pass, bits=bits), f"kind byte, name long, content long, {KEY_TYPE}, at long, size long")
    where = F.struct(*KEY, "at")
    by_name, by_content = W.partitionBy("name"), W.partitionBy("name", "content")
    # Settled and open segments only pass through: their names are hashes of their places.
    found = (
        segs.withColumn("rows", F.count("*").over(by_name))
        .where((F.col("rows") > 1) | (F.col("kind") >= OPEN))
        .withColumn("several", F.max((F.col("kind") == MARK).cast("int")).over(by_name) + (F.max("content").over(by_name) != F.min("content").over(by_name)).cast("int"))
        .where(F.col("kind") != MARK)
        .withColumn("again", where > F.min(where).over(by_content))
        .select(*KEY, "at", "size", F.when(F.col("kind") >= OPEN, F.col("kind").cast("int")).when(F.col("again"), GONE).when(F.col("several") > 0, OPEN).alias("kind"))
        .where("kind is not null")
    )
    found = materialize(found, "shared-segments")
    # Both joins with the texts read one exchange of them: they need the same columns by the same key.
    gathered = [F.collect_list("at").alias("starts"), F.collect_list("size").alias("sizes")]
    opened = found.where(F.col("kind") == OPEN).groupBy(*KEY).agg(*gathered)
    windows = texts.join(opened.hint("shuffle_merge"), KEY).select(*KEY, "text", "starts", "sizes").mapInArrow(_second_pass, f"gone boolean, a long, b long, {KEY_TYPE}, at long, size long")
    windows = materialize(windows, "open-windows")
    shared = windows.where("not gone").groupBy("a", "b").agg(F.count("*").alias("n"), F.min(where).alias("least")).where("n > 1").select("a", "b", "least")
    late = windows.where("not gone").join(shared.hint("shuffle_merge"), ["a", "b"]).where(where > F.col("least")).select(*KEY, "at", "size")
    gone = found.where(F.col("kind") == GONE).select(*KEY, "at", "size").unionByName(windows.where("gone").select(*KEY, "at", "size")).unionByName(late)
    return gone.groupBy(*KEY).agg(*gathered)


def dedup_substrings(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row, and ``kept_text`` if asked for.

    Words are runs of bytes other than blank and 9 to 13; a window is ``WINDOW`` consecutive words of one text. A
    word goes if a window that covers it also starts earlier: in a smaller doc_id, or earlier in the same text.
    Null texts are empty and have no word. Null doc_ids, and ids that are no integer, come first. Rows that share doc_id and text are one
    document and get the same result; rows with one doc_id (or none) and different texts come in the order of hashes of the texts.
    A text may repeat a word or a period without end. Other columns are not read; an empty table gives no row.
    In ``kept_text`` a text that loses nothing stays as it was (null included), any other has its words joined by blanks."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    keyed = documents.select(*row_key(F.col("doc_id"), text), F.col("doc_id"), text.alias("text"))
    places = removed_places(keyed)
    joined = keyed.join(places.hint("shuffle_merge"), KEY, "left").select("doc_id", "text", "starts", "sizes")
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"
    return joined.mapInArrow(_digest, schema + ", kept_text string") if with_text else joined.mapInArrow(_without_text, schema)


def _cut(batches):
    for batch in parts(batches):
        rest, starts, sizes = batch.column(0).flatten(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        names = [f.name for f in batch.column(0).type]
        at = names.index("text")
        done = [_kept(t, a, s) if a else (0, 0, b"") for t, a, s in zip(rest[at].to_pylist(), starts, sizes, strict=True)]
        changed = pa.array([gone > 0 for _, gone, _ in done], pa.bool_())
        texts = pa.array([kept.decode("utf-8", "surrogatepass") if gone else None for _, gone, kept in done], rest[at].type)
        rest[at] = pa.compute.if_else(changed, texts, rest[at])
        if "n_chars" in names:
            i = names.index("n_chars")
            rest[i] = pa.compute.if_else(changed, pa.compute.cast(pa.compute.utf8_length(texts), rest[i].type), rest[i])
        yield pa.RecordBatch.from_arrays(rest, names).filter(pa.array([kept != b"" or not gone for _, gone, kept in done], pa.bool_()))


def cut_repeats(documents: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns, without the words that ``dedup_substrings`` removes (n_chars follows the
    text). A text that loses all its words goes; one that loses none is unchanged. Columns may have any names."""
    keyed = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("row")).select(*row_key(F.col("row.doc_id"), F.col("row.text").cast("string")), "row")
    places = removed_places(keyed.select(*KEY, F.col("row.text").cast("string").alias("text")))
    joined = keyed.join(places.hint("shuffle_merge"), KEY, "left").select("row", "starts", "sizes")
    return joined.mapInArrow(_cut, documents.schema)
