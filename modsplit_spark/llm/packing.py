"""Sequence packing by the online sum-of-squares rule.

A document is its token ids and a final 0, cut every ``LENGTH`` ids. Whole pieces fill a sequence each. The
rest of each document is cut once more, at its last multiple of ``FINE`` ids, since sizes that divide the
window leave almost nothing open. Those pieces are placed online: a level array counts the partly filled windows at every
fill level, and a piece of size s goes to the level h (0 for a new window) that makes the sum of
squares of those counts least, which keeps the levels even and so finds mates for what comes.

Documents are tokenized once, in tasks, and only piece lengths and checksums go on, with a row number written beside them. Rests are
packed in groups of about ``GROUP`` pieces, hashed from that number, so groups grow in number, not in size, whatever the doc_ids are; each group
leaves only its last open windows padded.

Token ids are those of the given tokenizer file. White space of one blank or line break always splits
its input, so what lies between is encoded once and its ids kept in a bounded table per worker; texts with other
white space are encoded whole.
"""

from __future__ import annotations

import os
import zlib
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modsplit_spark.llm.bytegrams import parts
from modsplit_spark.sources.workspace import materialize

LENGTH = 1024
FINE = 128
GROUP = 8192
KEPT_CHUNKS = 200_000
KEPT_CHARS = 48
SPECIAL = "<|"


class ChunkIds(dict):
    """Little-endian ids of a blank and a chunk, or of a chunk that starts with a line break; None where
    a chunk can't be told apart from its neighbours."""

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes | None:
        body = chunk[1:] if chunk[:1] == "\n" else chunk
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        text = chunk if chunk[0] == "\n" else f" {chunk}"
        ids = self.whole(text) if SPECIAL in chunk else array("I", self.fast.encode_ordinary(text)).tobytes()
        if len(chunk) <= KEPT_CHARS and len(self) < KEPT_CHUNKS:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        chunks = f"\n{text}".replace("\n", " \n")[1:].split(" ")
        try:
            return b"".join(map(self.__getitem__, chunks))[len(self.break_ids) :]
        except TypeError:
            return self.whole(text)

    @property
    def break_ids(self) -> bytes:
        if not hasattr(self, "_break"):
            self._break = self.whole("\n")
        return self._break


_TABLES: dict[tuple, ChunkIds] = {}


def tokenizer_files() -> tuple[str, str, str]:
    """Tokenizer file, the same vocabulary as ranks, and its pattern."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def _table(files: tuple[str, str, str] | None) -> ChunkIds:
    files = files or tokenizer_files()
    if files not in _TABLES:
        _TABLES[files] = ChunkIds(*files)
    return _TABLES[files]


def _pieces(batches, files):
    table, checked = _table(files), False
    for batch in parts(batches):
        texts = batch.column(1).to_pylist()
        rows, starts, lengths, crcs, totals = [], [], [], [], []
        for i, text in enumerate(texts):
            ids = table.encode(text or "")
            if text and not checked:
                if ids != table.whole(text):
                    raise RuntimeError("the two forms of the vocabulary disagree")
                checked = True
            ids = memoryview(ids + b"\0\0\0\0")
            n = len(ids) // 4
            cuts = [*range(0, n, LENGTH), *sorted({n - n % FINE, n})]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e > s:
                    rows.append(i)
                    starts.append(s)
                    lengths.append(e - s)
                    crcs.append(zlib.crc32(ids[4 * s : 4 * e]))
                    totals.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
        )


def tokenized_pieces(documents: DataFrame, files: tuple[str, str, str] | None = None) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``: every document cut every ``LENGTH`` ids and at its last multiple of ``FINE``. Null texts are empty."""
    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(partial(_pieces, files=files), T.StructType([documents.schema["doc_id"], *longs]))


def sum_of_squares(sizes: list[int], capacity: int = LENGTH) -> list[tuple[int, int]]:
    """(window, offset) of each size in turn, windows numbered as they open. Sizes are 1 to ``capacity``."""
    counts = np.zeros(capacity + 1, np.int64)
    open_windows: list[list[int]] = [[] for _ in range(capacity + 1)]
    placed, opened = [], 0
    for s in sizes:
        best_level, best = 0, (2 * int(counts[s]) + 1 if s < capacity else 0)
        held = counts[1 : capacity - s + 1]
        if len(held):
            change = 2 * (counts[1 + s : capacity + 1] - held) + 2
            change[-1] = 1 - 2 * held[-1]  # a window that this piece fills leaves the level array
            change[held == 0] = 1 << 40
            at = len(change) - 1 - int(change[::-1].argmin())
            if change[at] <= best:
                best_level, best = at + 1, int(change[at])
        if best_level:
            window = open_windows[best_level].pop()
            counts[best_level] -= 1
        else:
            window, opened = opened, opened + 1
        placed.append((window, best_level))
        if best_level + s < capacity:
            counts[best_level + s] += 1
            open_windows[best_level + s].append(window)
    return placed


def _pack_group(table: pa.Table, width: int) -> pa.Table:
    table = table.take(pa.array(np.argsort(table["_place"].to_numpy(), kind="stable")))
    placed = sum_of_squares(table["length"].to_pylist())
    group = table["_group"].to_numpy().astype(np.int64)
    windows = np.array([w for w, _ in placed], np.int64)
    if len(windows) and windows.max() >= width:
        raise RuntimeError("a group has more windows than its width")
    out = table.drop_columns(["_group", "_place"])
    return out.append_column("sequence_id", pa.array(2 * (group * width + windows))).append_column("offset", pa.array([o for _, o in placed], pa.int64()))


def pack(documents: DataFrame, files: tuple[str, str, str] | None = None, group: int = GROUP) -> DataFrame:
    """The digest of ``op6``: one row per piece with its sequence and offset.

    Even sequence ids are windows of rests, odd ones hold one whole piece. Null texts are empty and
    have one id (the final 0). Null and repeated doc_ids are like any others: repeated rows are packed as often as they occur. An empty
    table gives no row. Other columns are not read."""
    pieces = materialize(tokenized_pieces(documents, files).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.where(F.col("length") < LENGTH).count() // group))
    rests = pieces.where(F.col("length") < LENGTH).withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(4)), F.lit(groups))).withColumn("_place", F.xxhash64("_row", F.lit(3))).drop("_row")
    # A group has at most as many windows as pieces.
    width = rests.groupBy("_group").count().agg(F.max("count")).first()[0] or 1
    fields = [*rests.drop("_group", "_place").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]

    def in_windows(table: pa.Table) -> pa.Table:
        return _pack_group(table, width)

    packed = rests.groupBy("_group").applyInArrow(in_windows, T.StructType(fields))
    whole = pieces.where(F.col("length") == LENGTH).withColumn("sequence_id", 2 * F.col("_row") + 1).withColumn("offset", F.lit(0).cast("long")).drop("_row")
    return packed.unionByName(whole)
