"""Media columns: payloads kept as lossless WebP images, and read back from the stored bytes.

``decode`` reads a lossless WebP file: prefix codes (simple and normal, in groups chosen by an entropy
image), back-references, the colour cache, and the predictor, cross-colour, subtract-green and
palette transforms, and gives an array of height x width x (A, R, G, B). ``encode_samples`` stores
8-bit samples as the green channel of such images, in the shortest of three forms: literals of one fitted prefix code; literals
and back-references, where a passage of ``MATCH`` bytes and more repeats; or a palette, several samples to a pixel, where at most
16 values occur. Samples of no grey image gain by predictors, cross-colour or a colour cache, so that these are only read.
An image without cache and entropy image whose red, blue and alpha have one symbol is decoded
by array passes; any other by the sequential reader.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modsplit_spark.llm.bytegrams import parts
from modsplit_spark.llm.wordhash import BASES, range_hash, range_sums

# Fixed values of the format.
SIGNATURE = 0x2F
MAX_SIDE = 1 << 14
LENGTH_CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
COLOUR_HASH = 0x1E35A7BD
GREEN, DISTANCE = 256 + 24, 40

BLOCK = 64
STRIDE_BITS = 4
PASS_BYTES = 1 << 14
#: Bytes of a payload that one image holds; a longer payload is several images, one file after the other.
IMAGE_BYTES = 1 << 24
#: Bytes that a back-reference must repeat, and how far back it may reach (a fixed value of the format).
MATCH, FARTHEST = 32, (1 << 20) - 120


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: np.ndarray, limit: int = 15) -> list[int]:
    """Lengths of a prefix code for the symbols with a count, none over ``limit``."""
    counts = counts.astype(np.int64)
    while True:
        used = np.flatnonzero(counts).tolist()
        lengths = [0] * len(counts)
        if len(used) == 1:
            lengths[used[0]] = 1
            return lengths
        nodes = [(int(counts[s]), i) for i, s in enumerate(used)]
        heapq.heapify(nodes)
        n, parents = len(nodes), {}
        while len(nodes) > 1:
            (a, i), (b, j) = heapq.heappop(nodes), heapq.heappop(nodes)
            parents[i] = parents[j] = n
            heapq.heappush(nodes, (a + b, n))
            n += 1
        depth = {n - 1: 0}
        for k in range(n - 2, -1, -1):
            depth[k] = depth[parents[k]] + 1
        for i, s in enumerate(used):
            lengths[s] = depth[i]
        if max(lengths) <= limit:
            return lengths
        counts = np.where(counts > 0, (counts + 1) // 2, 0)


def _reversed_bits() -> np.ndarray:
    x = np.arange(1 << 16, dtype=np.uint32)
    out = np.zeros(1 << 16, np.uint32)
    for k in range(16):
        out |= ((x >> np.uint32(k)) & np.uint32(1)) << np.uint32(15 - k)
    return out


REVERSED = _reversed_bits()


def canonical(lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, lengths and codes as they stand in the stream (first bit lowest), by length and symbol."""
    lengths = np.asarray(lengths)
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
    sizes = lengths[symbols]
    spans = 1 << (16 - sizes)
    return symbols, sizes, REVERSED[(np.cumsum(spans) - spans) & 0xFFFF]


class Code:
    """A prefix code as look-up arrays over the next ``bits`` bits."""

    def __init__(self, lengths):
        symbols, sizes, _ = canonical(lengths)
        if len(symbols) < 2:
            self.bits, self.symbol, self.length = 0, np.array([symbols[0] if len(symbols) else 0], np.int32), np.zeros(1, np.int32)
        else:
            self.bits = int(sizes[-1])
            spans = 1 << (self.bits - sizes)
            if spans.sum() != 1 << self.bits:
                raise ValueError("a prefix code is not complete")
            window = REVERSED[: 1 << self.bits] >> np.uint32(16 - self.bits)
            self.symbol, self.length = np.repeat(symbols.astype(np.int32), spans)[window], np.repeat(sizes.astype(np.int32), spans)[window]

    @functools.cached_property
    def literals_only(self) -> bool:
        return int(self.symbol.max()) < 256

    @functools.cached_property
    def table(self) -> list[tuple[int, int]]:
        return list(zip(self.symbol.tolist(), self.length.tolist(), strict=True))


@functools.lru_cache(512)
def single(symbol: int) -> Code:
    return Code([0] * symbol + [1])


class Writer:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.size
        self.size += bits


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def get(self, bits: int) -> int:
        at = self.at
        if at + bits > 8 * len(self.data):
            raise ValueError("the image ends early")
        self.at += bits
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << bits) - 1)

    def symbol(self, code: Code) -> int:
        if not code.bits:
            return int(code.symbol[0])
        at = self.at
        window = int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << code.bits) - 1)
        symbol, length = code.table[window]
        self.at += length
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends early")
        return symbol


def write_code(w: Writer, lengths: list[int]) -> None:
    """One prefix code: in the simple form if it has one symbol (or none), else as coded lengths."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1 and max(used, default=0) < 256:
        w.put(1, 1)
        w.put(0, 1)
        s = max(used, default=0)
        w.put(int(s > 1), 1)
        w.put(s, 8 if s > 1 else 1)
        return
    runs, i = [], 0
    stop = max(used) + 1
    while i < stop:
        n = lengths[i]
        k = i
        while k < stop and lengths[k] == n:
            k += 1
        size = k - i
        i = k
        if n == 0:
            while size >= 3:
                take = min(size, 138)
                runs.append((18, take - 11, 7) if take >= 11 else (17, take - 3, 3))
                size -= take
            runs += [(0, 0, 0)] * size
        else:
            runs.append((n, 0, 0))
            size -= 1
            while size >= 3:
                take = min(size, 6)
                runs.append((16, take - 3, 2))
                size -= take
            runs += [(n, 0, 0)] * size
    inner = code_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
    if sum(1 for n in inner if n) == 1:
        inner[0 if not inner[0] else 1] = 1  # a code of two symbols, so that every length takes a bit
    w.put(0, 1)
    shown = max(4, max(k for k, s in enumerate(LENGTH_CODE_ORDER) if inner[s]) + 1)
    w.put(shown - 4, 4)
    for s in LENGTH_CODE_ORDER[:shown]:
        w.put(inner[s], 3)
    w.put(1, 1)
    # The number of coded lengths that follow, in a field of 2 + 2k bits.
    k = max(0, -(-((len(runs) - 2).bit_length() - 2) // 2))
    w.put(k, 3)
    w.put(max(0, len(runs) - 2), 2 + 2 * k)
    codes = {s: (c, n) for s, n, c in zip(*(x.tolist() for x in canonical(inner)), strict=True)}
    if len(runs) < 2:
        runs.append((0, 0, 0))
    for s, extra, bits in runs:
        w.put(*codes[s])
        w.put(extra, bits)


def read_code(r: Reader, size: int) -> Code:
    lengths = [0] * size
    if r.get(1):
        two, wide = r.get(1), r.get(1)
        symbol = r.get(8 if wide else 1)
        if not two:
            return single(symbol)
        lengths[symbol] = lengths[r.get(8)] = 1
        return Code(lengths)
    inner = [0] * 19
    for s in LENGTH_CODE_ORDER[: 4 + r.get(4)]:
        inner[s] = r.get(3)
    code = Code(inner)
    left = 2 + r.get(2 + 2 * r.get(3)) if r.get(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = r.symbol(code)
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
            continue
        n, value = (3 + r.get(2), last) if s == 16 else (3 + r.get(3), 0) if s == 17 else (11 + r.get(7), 0)
        if at + n > size:
            raise ValueError("too many code lengths")
        lengths[at : at + n] = [value] * n
        at += n
    return Code(lengths)


# ---------------------------------------------------------------- pixels


def _extent(r: Reader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.get(extra) + 1


def _reference(r: Reader, symbol: int, distance: Code, width: int) -> tuple[int, int]:
    """Length and distance in pixels of a back-reference whose length symbol has been read."""
    n = _extent(r, symbol - 256)
    d = _extent(r, r.symbol(distance))
    if d > len(NEAR):
        return n, d - len(NEAR)
    x, y = NEAR[d - 1]
    return n, max(1, x + y * width)


def read_pixels(r: Reader, width: int, height: int, top: bool) -> np.ndarray:
    """``height * width`` ARGB numbers. Only the image itself (``top``) may have an entropy image."""
    cache_bits = r.get(4) if r.get(1) else 0
    side, group_of = 0, None
    if top and r.get(1):
        side = 2 + r.get(3)
        across = (width + (1 << side) - 1) >> side
        down = (height + (1 << side) - 1) >> side
        group_of = (read_pixels(r, across, down, False).reshape(down, across) >> 8) & 0xFFFF
    groups = [
        [read_code(r, n) for n in (GREEN + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE)]
        for _ in range(1 if group_of is None else int(group_of.max()) + 1)
    ]
    total = width * height
    green, red, blue, alpha, distance = groups[0]
    if group_of is None and not (cache_bits or red.bits or blue.bits or alpha.bits):
        base = (int(alpha.symbol[0]) << 24) | (int(red.symbol[0]) << 16) | int(blue.symbol[0])
        return (read_samples(r, green, distance, width, total).astype(np.uint32) << np.uint32(8)) | np.uint32(base)
    out, i = [0] * total, 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    cached = 0
    while i < total:
        if group_of is not None:
            green, red, blue, alpha, distance = groups[group_of[i // width >> side, i % width >> side]]
        s = r.symbol(green)
        if s < 256:
            x = r.symbol(red)
            b = r.symbol(blue)
            out[i] = (r.symbol(alpha) << 24) | (x << 16) | (s << 8) | b
            i += 1
        elif s < GREEN:
            n, d = _reference(r, s, distance, width)
            if d > i or i + n > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                out[i] = out[i - d]
                i += 1
        else:
            while cached < i:
                cache[(COLOUR_HASH * out[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out[i] = cache[s - GREEN]
            i += 1
    return np.array(out, np.uint32)


def _steps(words: np.ndarray, windows: np.ndarray, code: Code, distance: Code) -> np.ndarray:
    """For every bit position how far the next symbol is, if one begins there: a literal, or a back-reference with all its parts."""
    step = code.length[windows]
    if code.literals_only:
        return step
    symbol = code.symbol[windows]
    at = np.flatnonzero(symbol >= 256)
    if len(at):
        extra = lambda s: np.where(s < 4, 0, (s - 2) >> 1)
        step[at] += extra(symbol[at] - 256)
        there = np.minimum(at + step[at], 8 * len(words) - 1)
        window = (words[there >> 3] >> (there & 7).astype(np.uint32)) & np.uint32((1 << distance.bits) - 1)
        step[at] += distance.length[window] + extra(distance.symbol[window])
    return step


def read_samples(r: Reader, code: Code, distance: Code, width: int, count: int) -> np.ndarray:
    """``count`` green samples, by array passes over ``PASS_BYTES`` at a time: the step from every bit
    position, steps joined by doubling, one look-up for every 2^STRIDE_BITS symbols, and the places between filled in. Literals
    are put in their places at once, then back-references copied in order."""
    out = np.zeros(count, np.uint8)
    if not code.bits and code.symbol[0] < 256:
        out[:] = code.symbol[0]
        return out
    data, done = np.frombuffer(r.data + bytes(16), np.uint8), 0
    if not code.bits:
        raise ValueError("an image of back-references alone")
    while done < count:
        first, at = r.at >> 3, r.at & 7
        size = min(PASS_BYTES, len(r.data) - first)
        if size <= 0:
            raise ValueError("the image ends early")
        x = data[first : first + size + 12].astype(np.uint32)
        words = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
        windows = ((words[:size, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << code.bits) - 1)).ravel()
        stop = 8 * size
        step = np.empty(stop + 1, np.int32)
        step[:stop], step[stop] = np.minimum(np.arange(stop, dtype=np.int32) + _steps(words, windows, code, distance), stop), stop
        jumps = [step]
        for _ in range(STRIDE_BITS):
            jumps.append(jumps[-1][jumps[-1]])
        far, places, most = memoryview(jumps[-1]), [], ((count - done) >> STRIDE_BITS) + 1
        while at < stop and len(places) < most:
            places.append(at)
            at = far[at]
        here = np.array(places, np.int64)
        for k in range(STRIDE_BITS - 1, -1, -1):
            here = np.stack([here, jumps[k][here]], axis=1).ravel()
        here = here[: min(count - done, int(np.searchsorted(here, stop)))]
        symbol = code.symbol[windows[here]]
        if code.literals_only:
            out[done : done + len(here)] = symbol
            done += len(here)
            r.at = 8 * first + int(here[-1]) + int(code.length[windows[here[-1]]])
            continue
        sizes, references, more = np.ones(len(here), np.int64), [], 0
        for i in np.flatnonzero(symbol >= 256).tolist():
            if done + i + more >= count:
                break  # what follows the last sample is no symbol
            r.at = 8 * first + int(here[i]) + int(code.length[windows[here[i]]])
            sizes[i], d = _reference(r, int(symbol[i]), distance, width)
            references.append((i, int(sizes[i]), d, r.at))
            more += int(sizes[i]) - 1
        ends = done + np.cumsum(sizes)
        used = int(np.searchsorted(ends, count, "left")) + 1 if ends[-1] >= count else len(here)
        begins = (ends - sizes)[:used]
        literal = symbol[:used] < 256
        out[begins[literal]] = symbol[:used][literal]
        for i, n, d, _ in references:
            if i < used:
                start = int(begins[i])
                if d > start or start + n > count:
                    raise ValueError("a back-reference leaves the image")
                out[start : start + n] = out[start - d : start - d + n] if d >= n else np.resize(out[start - d : start], n)
        last = used - 1
        r.at = next((end for i, _, _, end in references if i == last), 8 * first + int(here[last]) + int(code.length[windows[here[last]]]))
        done = int(ends[last])
    if r.at > 8 * len(r.data):
        raise ValueError("the image ends early")
    return out


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _predict(mode: int, left, above, right, corner):
    """The predicted pixel from its neighbours (left, above, above right, above left), channel by channel."""
    if mode == 0 or mode > 13:
        return (255, 0, 0, 0)
    if mode in (1, 2, 3, 4):
        return (left, above, right, corner)[mode - 1]
    mean = lambda a, b: [(p + q) >> 1 for p, q in zip(a, b, strict=True)]
    if mode == 5:
        return mean(mean(left, right), above)
    if mode in (6, 7, 8, 9):
        return mean(*((left, corner), (left, above), (corner, above), (above, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(above, right))
    if mode == 11:
        near_left = sum(abs(a - c) for a, c in zip(above, corner, strict=True))
        near_above = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if near_left < near_above else above
    clamp = lambda v: min(255, max(0, v))
    if mode == 12:
        return [clamp(x + a - c) for x, a, c in zip(left, above, corner, strict=True)]
    half = mean(left, above)
    return [clamp(h + int((h - c) / 2)) for h, c in zip(half, corner, strict=True)]


def undo_predictor(argb: np.ndarray, modes: np.ndarray, side: int) -> np.ndarray:
    """``argb`` (height x width) of residuals; the mode of a block is the green of its pixel in ``modes``."""
    height, width = argb.shape
    x = _channels(argb).tolist()
    for i in range(height):
        for j in range(width):
            if i == 0:
                guess = (255, 0, 0, 0) if j == 0 else x[0][j - 1]
            elif j == 0:
                guess = x[i - 1][0]
            else:
                above = x[i - 1]
                right = above[j + 1] if j + 1 < width else x[i][0]
                guess = _predict(int(modes[i >> side, j >> side] >> 8) & 15, x[i][j - 1], above[j], right, above[j - 1])
            x[i][j] = [(a + b) & 255 for a, b in zip(x[i][j], guess, strict=True)]
    x = np.array(x, np.uint32)
    return (x[..., 0] << np.uint32(24)) | (x[..., 1] << np.uint32(16)) | (x[..., 2] << np.uint32(8)) | x[..., 3]


def undo_cross_colour(argb: np.ndarray, factors: np.ndarray, side: int) -> np.ndarray:
    c = _channels(argb)
    height, width = argb.shape
    f = _channels(factors)[np.arange(height)[:, None] >> side, np.arange(width)[None, :] >> side]
    signed = lambda v: np.where(v > 127, v - 256, v)
    delta = lambda t, v: (signed(t) * signed(v)) >> 5
    red = (c[..., 1] + delta(f[..., 3], c[..., 2])) & 255
    blue = (c[..., 3] + delta(f[..., 2], c[..., 2]) + delta(f[..., 1], red)) & 255
    return (argb & np.uint32(0xFF00FF00)) | (red.astype(np.uint32) << np.uint32(16)) | blue.astype(np.uint32)


def undo_subtract_green(argb: np.ndarray) -> np.ndarray:
    green = (argb >> np.uint32(8)) & np.uint32(255)
    both = (argb & np.uint32(0x00FF00FF)) + (green << np.uint32(16) | green)
    return (argb & np.uint32(0xFF00FF00)) | (both & np.uint32(0x00FF00FF))


def undo_palette(argb: np.ndarray, palette: np.ndarray, width: int, packed: int) -> np.ndarray:
    """Indices are in green, ``1 << packed`` of them to a pixel; an index beyond the palette is transparent black."""
    bits = 8 >> packed
    green = (argb >> np.uint32(8)) & np.uint32(255)
    index = (green[..., None] >> (np.arange(1 << packed, dtype=np.uint32) * np.uint32(bits))) & np.uint32((1 << bits) - 1)
    index = index.reshape(argb.shape[0], -1)[:, :width]
    return np.concatenate([palette, np.zeros(256, np.uint32)])[index]


def decode(media: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file as height x width x (A, R, G, B), 8 bits each."""
    return _channels(decode_argb(media)).astype(np.uint8)


def decode_argb(media: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file as height x width numbers of 32 bits."""
    if media[:4] != b"RIFF" or media[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    r = Reader(media[20 : 20 + int.from_bytes(media[16:20], "little")])
    if r.get(8) != SIGNATURE:
        raise ValueError("not a lossless WebP image")
    width, height = r.get(14) + 1, r.get(14) + 1
    r.get(1)
    if r.get(3):
        raise ValueError("unknown version")
    full, undo = width, []
    blocks = lambda n, side: (n + (1 << side) - 1) >> side
    while r.get(1):
        kind = r.get(2)
        if kind in (0, 1):
            side = 2 + r.get(3)
            data = read_pixels(r, blocks(width, side), blocks(height, side), False).reshape(blocks(height, side), -1)
            undo.append((kind, data, side))
        elif kind == 2:
            undo.append((kind, None, 0))
        else:
            size = r.get(8) + 1
            entries = _channels(read_pixels(r, size, 1, False))
            entries = (np.cumsum(entries, axis=0) & 255).astype(np.uint32)
            palette = (entries[:, 0] << np.uint32(24)) | (entries[:, 1] << np.uint32(16)) | (entries[:, 2] << np.uint32(8)) | entries[:, 3]
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((kind, (palette, width), packed))
            width = blocks(width, packed)
    argb = read_pixels(r, width, height, True).reshape(height, width)
    for kind, data, side in reversed(undo):
        if kind == 0:
            argb = undo_predictor(argb, data, side)
        elif kind == 1:
            argb = undo_cross_colour(argb, data, side)
        elif kind == 2:
            argb = undo_subtract_green(argb)
        else:
            argb = undo_palette(argb, data[0], data[1], side)
    return argb.reshape(height, full)


# ---------------------------------------------------------------- storing samples


def wrapped(width: int, height: int, body: Writer, tail: bytes = b"") -> bytes:
    """The file: header, then the bits of ``body`` (which starts after the version), then whole bytes of ``tail``."""
    head = Writer()
    for value, bits in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        head.put(value, bits)
    head.put(body.value, body.size)
    data = head.value.to_bytes((head.size + 7) // 8, "little") + tail
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + (12 + len(data) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + pad


def image_size(n: int) -> tuple[int, int]:
    """Width (a multiple of ``BLOCK``) and height for ``n`` samples: the least width whose height fits."""
    rows = n // BLOCK
    across = -(-rows // MAX_SIDE)
    return BLOCK * across, -(-rows // across)


def _bit_table(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol the bits of its code and which of them count."""
    symbols, sizes, codes = canonical(lengths)
    place = np.arange(sizes[-1] if len(symbols) > 1 else 0, dtype=np.uint32)
    bits, used = np.zeros((len(lengths), len(place)), np.uint8), np.zeros((len(lengths), len(place)), bool)
    if len(symbols) > 1:
        bits[symbols] = (codes[:, None] >> place) & np.uint32(1)
        used[symbols] = place < sizes[:, None]
    return bits, used


def _grey_codes(head: Writer, green: list[int], distance: list[int]) -> None:
    write_code(head, green)
    for _ in range(3):
        write_code(head, [1])
    write_code(head, distance)


def _file(width: int, height: int, head: Writer, chunks: list[np.ndarray]) -> bytes:
    """The file of a header and the bits that follow it; its last, partly filled byte begins them."""
    lead = (40 + head.size) & 7
    first = np.array([(head.value >> (head.size - lead + k)) & 1 for k in range(lead)], np.uint8)
    head.value &= (1 << (head.size - lead)) - 1
    head.size -= lead
    return wrapped(width, height, head, np.packbits(np.concatenate([first, *chunks]), bitorder="little").tobytes())


def _literal_bits(samples: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    bits, used = table
    return [bits[s][used[s]] for s in (samples[i : i + (1 << 18)] for i in range(0, len(samples), 1 << 18))] if used.shape[1] else []


def _literals(samples: np.ndarray, width: int, height: int, lengths: list[int]) -> bytes:
    head = Writer()
    head.put(0, 3)  # no transform, no colour cache, one group of codes
    _grey_codes(head, lengths, [1])
    return _file(width, height, head, _literal_bits(samples, _bit_table(lengths)))


def _palette(samples: np.ndarray, width: int, height: int) -> bytes:
    """At most 16 values as a palette; a pixel packs two, four or eight of them."""
    values = np.unique(samples)
    packed = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
    index = np.searchsorted(values, samples).reshape(-1, 1 << packed)
    pixels = (index << (np.arange(1 << packed) * (8 >> packed))).sum(axis=1).astype(np.uint8)
    steps = np.diff(values.astype(np.int64), prepend=0).astype(np.uint8)
    head = Writer()
    for value, bits in ((1, 1), (3, 2), (len(values) - 1, 8), (0, 1)):
        head.put(value, bits)
    own = code_lengths(np.bincount(steps, minlength=256))
    _grey_codes(head, own, [1])
    table = _bit_table(own)
    for bit in np.concatenate([*_literal_bits(steps, table), np.zeros(0, np.uint8)]).tolist():
        head.put(bit, 1)
    head.put(0, 3)
    lengths = code_lengths(np.bincount(pixels, minlength=256))
    _grey_codes(head, lengths, [1])
    return _file(width, height, head, _literal_bits(pixels, _bit_table(lengths)))


def repeats(samples: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of passages of ``MATCH`` bytes and more that begin with a word and stand earlier, from left to right."""
    if len(samples) < 2 * MATCH:
        return []
    at = np.flatnonzero(np.concatenate([[True], samples[: -MATCH] <= 32]))
    hashes = range_hash(range_sums(samples.astype(np.uint64) + np.uint64(1), BASES[0]), at, at + MATCH, BASES[0])
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    before = np.full(len(at), -1)
    before[order[1:][same]] = at[order[:-1][same]]
    found, end = [], 0
    for i in np.flatnonzero((before >= 0) & (at - before <= FARTHEST)).tolist():
        start, source = int(at[i]), int(before[i])
        if start < end:
            continue
        n, piece = 0, 256
        while start + n < len(samples):
            a, b = samples[start + n : start + n + piece], samples[source + n : source + n + piece]
            differs = a != b[: len(a)]
            if differs.any():
                n += int(differs.argmax())
                break
            n, piece = n + len(a), 4 * piece
        if n >= MATCH:
            found.append((start, n, start - source))
            end = start + n
    return found


def _coded(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number for a length or distance."""
    x = value - 1
    if x < 4:
        return x, 0, 0
    top = x.bit_length() - 1
    return 2 * top + ((x >> (top - 1)) & 1), x & ((1 << (top - 1)) - 1), top - 1


def _references(samples: np.ndarray, found: list[tuple[int, int, int]], width: int, height: int) -> bytes:
    """Literals, and a back-reference of up to 4,096 samples at a time for each repeat."""
    parts_, copies, at = [], [], 0
    literal = np.ones(len(samples), bool)
    for start, n, d in found:
        literal[start : start + n] = False
        pieces = [(_coded(min(4096, n - k)), _coded(d + len(NEAR))) for k in range(0, n, 4096)]
        copies.append((at, start, pieces))
        at = start + n
    green = np.bincount(samples[literal], minlength=GREEN)
    far = np.zeros(DISTANCE, np.int64)
    for _, _, pieces in copies:
        for (length, *_), (distance, *_) in pieces:
            green[256 + length] += 1
            far[distance] += 1
    green, far = code_lengths(green), code_lengths(far)
    head = Writer()
    head.put(0, 3)
    _grey_codes(head, green, far)
    table = _bit_table(green)
    of_green = {s: (c, n) for s, n, c in zip(*(x.tolist() for x in canonical(green)), strict=True)}
    of_far = {s: (c, n) for s, n, c in zip(*(x.tolist() for x in canonical(far)), strict=True)}
    if len(of_far) == 1:
        of_far = {s: (0, 0) for s in of_far}
    for before, start, pieces in copies:
        parts_ += _literal_bits(samples[before:start], table)
        w = Writer()
        for (length, extra, bits), (distance, extra_far, bits_far) in pieces:
            w.put(*of_green[256 + length])
            w.put(extra, bits)
            w.put(*of_far[distance])
            w.put(extra_far, bits_far)
        parts_.append(np.array([(w.value >> k) & 1 for k in range(w.size)], np.uint8))
    parts_ += _literal_bits(samples[at:], table)
    return _file(width, height, head, parts_)


def encode_image(piece: bytes) -> tuple[bytes, str]:
    """A grey image whose green samples are ``piece`` (a positive multiple of ``BLOCK``), then zeros to the last row's end, and its form, the
    one that takes the fewest bits (by an estimate for back-references)."""
    width, height = image_size(len(piece))
    samples = np.frombuffer(piece + b"\0" * (width * height - len(piece)), np.uint8)
    counts = np.bincount(samples, minlength=256)
    lengths = code_lengths(counts)
    if np.count_nonzero(counts) <= 16:
        made = [(_literals(samples, width, height, lengths), "literals"), (_palette(samples, width, height), "palette")]
        found = repeats(samples)
        made += [(_references(samples, found, width, height), "references")] if found else []
        return min(made, key=lambda m: len(m[0]))
    found = repeats(samples)
    # A back-reference has about 32 bits. Those that save less than a tenth are not worth a second code.
    bits = int(np.dot(counts, lengths))
    saved = sum(n for _, n, _ in found) * bits // len(samples) - 32 * len(found)
    return (_references(samples, found, width, height), "references") if 10 * saved >= bits else (_literals(samples, width, height, lengths), "literals")


def encode_samples(payload: bytes) -> tuple[bytes, str]:
    """The images of a payload, ``IMAGE_BYTES`` in each, one file after the other, and their forms."""
    made = [encode_image(payload[i : i + IMAGE_BYTES]) for i in range(0, len(payload), IMAGE_BYTES)]
    return b"".join(m for m, _ in made), "+".join(dict.fromkeys(f for _, f in made))


def decode_samples(media: bytes, n: int) -> bytes:
    """The first ``n`` samples of stored images."""
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        green = (decode_argb(media[at : at + size]).ravel() >> np.uint32(8)).astype(np.uint8)
        out.append(green[: min(IMAGE_BYTES, n)].tobytes())
        n -= len(out[-1])
        at += size
    return b"".join(out)


def features(samples: bytes) -> str:
    """Mean, and the share of samples in each sixteenth of the range, in thousandths, of what was read back."""
    x = np.frombuffer(samples, np.uint8)
    shares = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};hist=" + ",".join(map(str, shares.tolist()))


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (BLOCK - len(raw) % BLOCK if len(raw) % BLOCK or not raw else 0), len(raw)


def _stored(batches):
    for batch in parts(batches):
        out = []
        for text in batch.column(1).to_pylist():
            data, n = payload(text)
            media, form = encode_samples(data)
            back = decode_samples(media, len(data))
            if back != data:
                raise RuntimeError("an image did not read back as stored")
            out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(back), form))
        columns = list(zip(*out, strict=True)) or [()] * 8
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ["doc_id", *(f.name for f in DIGEST)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)


DIGEST = [
    T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("form", T.StringType()),
]


def media_digest(documents: DataFrame) -> DataFrame:
    """The digest of ``op3``: each whole text stored as a lossless image, read back and described.

    Null texts are empty (one block of zeros). Equal texts give equal values; repeated rows stay repeated. A text of any length is kept, as
    several images if need be; ``form`` says how its samples are stored. Other columns are not read; an empty table gives no row."""
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(_stored, T.StructType([documents.schema["doc_id"], *DIGEST]))


def _encoded(batches):
    for batch in parts(batches):
        media = [encode_samples(payload(t)[0])[0] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])


def with_media(documents: DataFrame) -> DataFrame:
    """``(doc_id, media)``: the stored images themselves, of a long text several files in a row."""
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(_encoded, T.StructType([documents.schema["doc_id"], T.StructField("media", T.BinaryType())]))


def _pixels(batches):
    for batch in parts(batches):
        rows = [None if m is None else decode(m) for m in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([None if x is None else x.shape[1] for x in rows], pa.int32()), pa.array([None if x is None else x.shape[0] for x in rows], pa.int32()), pa.array([None if x is None else x.tobytes() for x in rows], pa.binary())],
            ["id", "width", "height", "argb"],
        )


def read_media(table: DataFrame, key: str, media: str) -> DataFrame:
    """``(key, width, height, argb)`` of a column of lossless WebP files; argb has four bytes a pixel. Null media give nulls."""
    fields = [T.StructField(key, table.schema[key].dataType), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("argb", T.BinaryType())]
    return table.select(key, F.col(media)).mapInArrow(lambda it: (b.rename_columns([key, "width", "height", "argb"]) for b in _pixels(it)), T.StructType(fields))
