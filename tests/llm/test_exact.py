"""Operators against brute force, exact round trips and held-out accuracy."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from modsplit_spark.llm import decontamination as D
from modsplit_spark.llm import html_template, packing, sharding, simhash, substring_dedup, toxicity, webp
from modsplit_spark.llm import language_id as L
from modsplit_spark.llm.wordhash import word_hashes


def test_lpt_matches_plain_schedule_and_is_near_equal(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdef") * rng.randrange(1, 9) for _ in range(rng.randrange(15, 60))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:50])], "doc_id long, text string")
    got = sharding.shard_documents(rows, 4).collect()
    assert {len({r["shard"] for r in got if r["text_crc32"] == c}) for c in {r["text_crc32"] for r in got}} == {1}
    loads = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert max(loads) - min(loads) <= max(r["size"] for r in got)
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    sizes = {}
    for r in got:
        sizes[r["text_crc32"]] = sizes.get(r["text_crc32"], 0) + r["size"]
    # With items this large every group is its own, so the whole is plain LPT: by size, each to the least-loaded shard.
    assert sharding.BUNDLES and min(sizes.values()) * 4 * sharding.GRAIN >= sum(sizes.values())
    plain = [0] * 4
    for size in sorted(sizes.values(), reverse=True):
        plain[plain.index(min(plain))] += size
    assert sorted(loads) == sorted(plain)
    assert sharding.longest_first([(5, "a"), (4, "b"), (3, "c"), (3, "d")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def _plain_print(text, words=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _plain_components(prints, t=2):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= t:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def test_simhash_against_all_pairs(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    texts = base + [" ".join(w if rng.random() > 0.004 else "zz" for w in rng.choice(base).split()) for _ in range(120)] + ["", None, "one", "Two\tWORDS", "two words"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(rows).collect()}
    prints = {i: _plain_print(t) for i, t in enumerate(texts)}
    roots = _plain_components(sorted(set(prints.values())))
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], i), i)
    assert got == {i: (f"{p:016x}", least[roots[p]]) for i, p in prints.items()}


def test_crowded_keys_link_like_all_pairs(spark):
    rng = random.Random(6)
    centre = rng.getrandbits(63)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(4))) for _ in range(300)} | {rng.getrandbits(63) for _ in range(50)}
    frame = spark.createDataFrame([(p,) for p in prints], "print long")
    for t in (0, 1, 2):
        from modsplit_spark.operators.components import connected_components

        joined = {r["node"]: r["component"] for r in connected_components(simhash.links(frame, t)).collect()}
        want = _plain_components(sorted(prints), t)
        assert {p: joined.get(p, p) for p in prints} == want, t


def test_pigeonhole_plan():
    assert simhash.allocate([[0, 5, 50], [0, 9, 10], [0, 1, 100]], 0) == (11, [-1, 1, 0])
    both = np.full((64, 64), 0.25) + np.eye(64) * 0.25
    for n in (10**3, 10**6, 10**10):
        plan = simhash.plan_parts(n, both, 2)
        used = sum(len(bits) for bits, _ in plan)
        assert used <= 64 and all(k >= 0 for _, k in plan)


def _plain_repeats(rows):
    seen, out = {}, {}
    docs = {d: (t or "").encode().split() for d, t in sorted(rows)}
    gone = {d: set() for d in docs}
    for d, w in docs.items():
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[d] |= set(range(i, i + 20))
            seen[key] = True
    for d, w in docs.items():
        import hashlib

        out[d] = (len(w), len(gone[d]), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone[d])).hexdigest())
    return out


def test_substring_dedup_against_every_window(spark):
    rng = random.Random(8)
    word = lambda n: [f"w{rng.randrange(n)}" for _ in range(rng.randrange(5, 80))]
    shared = [word(50) for _ in range(12)]
    rows = []
    for d in range(250):
        parts = [rng.choice([word(50), word(3), ["a"] * rng.randrange(60), ["a", "b"] * rng.randrange(30), rng.choice(shared), rng.choice(shared)[5:]]) for _ in range(rng.randrange(6))]
        rows.append((d, " ".join(w for p in parts for w in p)))
    rows += [(900 + i, rows[i][1]) for i in range(20)] + [(999, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup_substrings(frame).collect()}
    assert got == _plain_repeats(rows)
    old = substring_dedup.CHUNK_BYTES
    try:
        substring_dedup.CHUNK_BYTES = 2000
        places = {i for chunk in substring_dedup._chunks(iter([])) for i in chunk}
        assert places == set()
    finally:
        substring_dedup.CHUNK_BYTES = old


def test_leaks_against_alignment_with_every_item():
    rng = random.Random(9)
    words = [f"v{i}" for i in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(5, 50)))) for k in range(24)] + [(24 + k, " ".join(f"s{k}x{i}" for i in range(k + 1))) for k in range(5)] + [(29, " ".join(rng.choices(words, k=200)))]
    texts = []
    for k in range(150):
        w = items[k % 30][1].split()
        for _ in range(rng.randrange(D.edits(len(w)) + 2)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], ["new"], [w[i], "more"]])
        around = rng.choices(words, k=40)
        texts.append(D._prepared(" ".join(around[:20] + w + around[20:])))
    index = D.Index(items)
    got = {(t, i): e for t, i, _, _, e, _ in D.leaks(texts, index)}
    want = {}
    for t, text in enumerate(texts):
        w = word_hashes([text], D.MARKS)[0]
        for j, item in enumerate(index.words):
            distance = D.align(item, w)[0]
            if distance <= index.edits[j]:
                want[t, index.ids[j]] = distance
    assert len(want) > 90 and len(set(want) - set(got)) <= 0.01 * len(want) and not set(got) - set(want)
    assert all(got[k] >= want[k] for k in got)


def test_recall_at_exactly_the_allowed_edits():
    rng = random.Random(31)
    for length, copies in ((10, 60), (60, 60), (200, 40), (300, 20)):
        items = [(k, " ".join(f"v{rng.randrange(10**6)}" for _ in range(length))) for k in range(10)]
        index, texts = D.Index(items), []
        for k in range(copies):
            w = items[k % 10][1].split()
            for i in rng.sample(range(length), D.edits(length)):
                w[i] = f"n{rng.randrange(10**6)}"
            texts.append(D._prepared(" ".join(["before"] * 30 + w + ["after"] * 30)))
        found = {(t, i) for t, i, *_ in D.leaks(texts, index)}
        assert sum((t, t % 10) in found for t in range(copies)) >= 0.95 * copies, length


def test_media_round_trip():
    rng = np.random.default_rng(1)
    line = b"A line that stands here more than once, word by word. "
    text = b" ".join(rng.choice([b"one", b"two", b"three", b"four", b"five"]) for _ in range(9000))
    pad = lambda x: x + bytes(-len(x) % 64)
    for data, form in (
        (b"\0" * 64, "literals"), (b"ab" * 3200, "palette"), (b"abcd" * 640, "palette"), (rng.integers(0, 16, 6400, dtype=np.uint8).tobytes(), None), (bytes(range(256)), "literals"), (rng.integers(0, 256, 64 * 700, dtype=np.uint8).tobytes(), "literals"),
        (pad(text + b" ".join(line + bytes(rng.integers(97, 123, 30, dtype=np.uint8)) for _ in range(60))), "references"), (pad(line * 4000), "references"), (pad(bytes(range(33, 127)) + b" " + line + bytes(200) + line), "references"),
        (b"x" * (64 * 20_000) + b"y" * 64, None),
    ):
        media, found = webp.encode_samples(data)
        assert webp.decode_samples(media, len(data)) == data and form in (found, None), (found, form)
        assert (webp.decode(media)[..., 2].ravel()[: len(data)] == np.frombuffer(data, np.uint8)).all()
    old = webp.IMAGE_BYTES
    try:
        webp.IMAGE_BYTES = 640
        data = pad(text)
        media, _ = webp.encode_samples(data)
        assert webp.decode_samples(media, len(data)) == data and media.count(b"WEBPVP8L") == -(-len(data) // 640)
    finally:
        webp.IMAGE_BYTES = old
    data, n = webp.payload("é" * 32)
    assert n == 64 and data == ("é" * 32).encode()


def test_a_file_worked_out_by_hand():
    # 2 x 1 pixels, no transform, no cache, one group; green: two symbols 5 and 9 of one bit; red 0, blue 0, alpha 255, distance 0 alone.
    bits = "0" + "0" + "0" + "1" + "1" + "1" + "10100000" + "10010000" + 2 * ("1" + "0" + "0" + "0") + "1" + "0" + "1" + "11111111" + "1" + "0" + "0" + "0" + "1" + "0"
    head = f"{0x2F:08b}"[::-1] + f"{1:014b}"[::-1] + f"{0:014b}"[::-1] + "0" + "000"
    stream = head + bits
    stream += "0" * (-len(stream) % 16)
    data = bytes(int(stream[i : i + 8][::-1], 2) for i in range(0, len(stream), 8))
    media = b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data
    assert webp.decode(media).tolist() == [[[255, 0, 9, 0], [255, 0, 5, 0]]]


def _eight(w, values):
    for v in values:
        w.put(int(format(int(v), "08b")[::-1], 2), 8)


def _plain_image(w, argb, top):
    """An image with one group of eight-bit codes for every channel."""
    w.put(0, 1)
    if top:
        w.put(0, 1)
    for k in range(4):
        webp.write_code(w, [8] * 256 + [0] * (24 if k == 0 else 0))
    webp.write_code(w, [1])
    for p in argb.ravel().tolist():
        _eight(w, ((p >> 8) & 255, (p >> 16) & 255, p & 255, p >> 24))


def _argb(x):
    return (x[..., 0].astype(np.uint32) << 24) | (x[..., 1].astype(np.uint32) << 16) | (x[..., 2].astype(np.uint32) << 8) | x[..., 3]


def test_transforms_are_undone():
    rng = np.random.default_rng(3)
    height, width = 9, 11
    x = rng.integers(0, 256, (height, width, 4)).astype(np.int64)
    # Subtract green, then read back.
    w = webp.Writer()
    w.put(1, 1), w.put(2, 2), w.put(0, 1)
    y = x.copy()
    y[..., 1], y[..., 3] = (x[..., 1] - x[..., 2]) & 255, (x[..., 3] - x[..., 2]) & 255
    _plain_image(w, _argb(y), True)
    assert (webp.decode(webp.wrapped(width, height, w)) == x).all()
    # Every predictor mode.
    for mode in range(14):
        res = np.zeros_like(x)
        for i in range(height):
            for j in range(width):
                if i == 0:
                    guess = (255, 0, 0, 0) if j == 0 else x[0, j - 1]
                elif j == 0:
                    guess = x[i - 1, 0]
                else:
                    right = x[i - 1, j + 1] if j + 1 < width else x[i, 0]
                    guess = webp._predict(mode, *(v.tolist() for v in (x[i, j - 1], x[i - 1, j], right, x[i - 1, j - 1])))
                res[i, j] = (x[i, j] - np.array(guess)) & 255
        w = webp.Writer()
        w.put(1, 1), w.put(0, 2), w.put(0, 3)
        modes = np.full((3, 3), mode << 8, np.uint32)
        _plain_image(w, modes, False)
        w.put(0, 1)
        _plain_image(w, _argb(res), True)
        assert (webp.decode(webp.wrapped(width, height, w)) == x).all(), mode
    # Cross-colour with signed factors.
    g2r, g2b, r2b = 200, 17, 130
    signed = lambda v: np.where(v > 127, v - 256, v)
    y = x.copy()
    y[..., 1] = (x[..., 1] - ((signed(np.int64(g2r)) * signed(x[..., 2])) >> 5)) & 255
    y[..., 3] = (x[..., 3] - ((signed(np.int64(g2b)) * signed(x[..., 2])) >> 5) - ((signed(np.int64(r2b)) * signed(x[..., 1])) >> 5)) & 255
    w = webp.Writer()
    w.put(1, 1), w.put(1, 2), w.put(0, 3)
    _plain_image(w, np.full((3, 3), (r2b << 16) | (g2b << 8) | g2r, np.uint32), False)
    w.put(0, 1)
    _plain_image(w, _argb(y), True)
    assert (webp.decode(webp.wrapped(width, height, w)) == x).all()
    # A palette of three, four indices to a pixel.
    palette = rng.integers(0, 256, (3, 4)).astype(np.int64)
    index = rng.integers(0, 3, (height, width))
    packed = np.zeros((height, 3), np.uint32)
    for j in range(width):
        packed[:, j // 4] |= (index[:, j] << (2 * (j % 4))).astype(np.uint32)
    w = webp.Writer()
    w.put(1, 1), w.put(3, 2), w.put(2, 8)
    _plain_image(w, _argb(np.diff(palette, axis=0, prepend=0) & 255)[None, :], False)
    w.put(0, 1)
    _plain_image(w, packed << np.uint32(8), True)
    assert (webp.decode(webp.wrapped(width, height, w)) == palette[index]).all()


def test_back_references_and_colour_cache():
    w = webp.Writer()
    w.put(0, 1), w.put(1, 1), w.put(1, 4), w.put(0, 1)  # a cache of two colours
    lengths = [0] * (256 + 24 + 2)
    lengths[7] = lengths[9] = lengths[256 + 2] = lengths[280] = 2  # two literals, a run of three, a cache entry
    cell = [(webp.COLOUR_HASH * c & 0xFFFFFFFF) >> 31 for c in (0xFF000700, 0xFF000900)]
    if cell[0]:
        lengths[280], lengths[281] = 0, 2
    webp.write_code(w, lengths)
    for k in range(3):
        webp.write_code(w, [0] * 255 + [1] if k == 2 else [1])
    webp.write_code(w, [0, 1])  # distance symbol 1: code 2, the pixel to the left
    code = {s: (c, n) for s, n, c in zip(*(x.tolist() for x in webp.canonical(lengths)), strict=True)}
    for s in (7, 258, 280 + cell[0], 9, 258):
        w.put(*code[s])
    green = webp.decode(webp.wrapped(9, 1, w))[0, :, 2].tolist()
    assert green == [7, 7, 7, 7, 7, 9, 9, 9, 9]


def test_tokens_and_windows():
    table = packing._table(None)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["the", "Wörter", " ", " ", "\n", "  ", "\t", "don't", "12", ".", "\u00a0", "<|endoftext|>", "漢字", "e\u0301", "\u0301", "\U0001f469\u200d\U0001f4bb", "\x85", "\u2028", "\x1c", "\x1f", "\r\n", "q" * 60]) for _ in range(rng.randrange(20)))
        assert table.encode(text) == table.whole(text), repr(text)
    sizes = [rng.randrange(1, 1025) for _ in range(500)]
    fill = {}
    for s, (window, offset) in zip(sizes, packing.sum_of_squares(sizes), strict=True):
        assert fill.get(window, 0) == offset
        fill[window] = offset + s
    assert max(fill.values()) <= 1024


def _plain_squares(sizes, capacity):
    """The rule by trying every level: counts of partly filled windows at each fill, least sum of squares, fullest level of equals."""
    open_, placed, opened = [], [], 0  # [window, fill], in the order in which they came to that fill
    for s in sizes:
        def total(level):
            fills = Counter(f for _, f in open_)
            if level:
                fills[level] -= 1
            if level + s < capacity:
                fills[level + s] += 1
            return sum(n * n for n in fills.values())

        level = min([0, *{f for _, f in open_ if f + s <= capacity}], key=lambda h: (total(h), -h))
        if level:
            at = max(i for i, (_, f) in enumerate(open_) if f == level)
            window = open_.pop(at)[0]
        else:
            window, opened = opened, opened + 1
        placed.append((window, level))
        if level + s < capacity:
            open_.append([window, level + s])
    return placed


def test_sum_of_squares_against_every_level():
    rng = random.Random(12)
    for capacity, most in ((16, 16), (64, 20), (128, 128)):
        sizes = [rng.randrange(1, most + 1) for _ in range(300)]
        assert packing.sum_of_squares(sizes, capacity) == _plain_squares(sizes, capacity)


def test_many_null_ids_share_no_window(spark):
    rows = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.lit("more "), (F.col("id") % 7).cast("int"))).alias("text"))
    found = packing.pack(rows)
    assert found.count() == 50_000
    fills = found.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("pieces"))
    # Gapless: what is in a sequence ends where its pieces add up to.
    assert fills.where("n > 1024 or n != end").count() == 0 and fills.count() < 1.12 * found.agg(F.sum("length")).first()[0] / 1024
    assert packing.pack(rows.limit(3000), group=100).groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    with np.testing.assert_raises(RuntimeError):
        packing._pack_group(pa.table({"length": [1000, 1000], "_group": [0, 0], "_place": [1, 2]}), 1)


def test_packed_ids_read_back(spark):
    texts = ["word " * n for n in (0, 1, 130, 1023, 1024, 3000)] + [None, "a\n\nb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack(rows).collect()
    table, used = packing._table(None), {}
    for d, text in enumerate(texts):
        ids = table.whole(text or "") + b"\0\0\0\0"
        pieces = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == len(ids) // 4 == pieces[0]["doc_tokens"]
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])
            used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024


def test_templates_and_extraction(spark):
    page = lambda i: f"<html><body><div><p>Same line on all</p></div><ul><li><a href='/x'>Go</a></li></ul><div id='content'><p>Own text {i} &copy;&nbsp;x</p><p class='share-bar'>Share</p></div><script>var t='</p>'</script></body></html>"
    rows = [(i, f"http://h.example.com/{i}", page(i)) for i in range(6)] + [(9, "http://other.example.com/", page(9))]
    got = {r["page_id"]: r["text"] for r in html_template.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own text 3 © x" and got[9] == "Same line on all\nOwn text 9 © x"
    article = "<nav>N</nav><div class=ad>A</div><article><h1>T</h1><p><b>One<br><p>Two &am"
    assert html_template.main_text(article) == "T\nOne\nTwo &am"
    assert html_template.main_text("<article><p>x</p><div class='comments'>c</div><aside>s</aside><footer>f</footer></article>") == "x"


def test_template_slots_decide(spark):
    page = lambda inner: f"<html><body><div><p>Same line</p></div>{inner}</body></html>"
    shared = page("<article><h1>T</h1><p>Copied text</p></article>")
    rows = [(i, "http://h.example.com/", shared) for i in range(4)]
    # A nested article that half of the host's pages lack is no slot of its own; a page without an article gives its other slots.
    rows += [(7, "http://h.example.com/7", page("<article><p>Kept</p><section><article><p>Also kept</p></article></section></article>"))]
    rows += [(8, "http://h.example.com/8", page("<div><p>Free text</p></div>")), (9, "http://h.example.com/9", page("<section><article><p>Off the template</p></article></section>"))]
    rows += [(10, "http://alone.example.com/", shared), (11, "http://alone.example.com/role", "<div role='main'><p>m</p></div><div><p>n</p></div>")]
    got = {r["page_id"]: r["text"] for r in html_template.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**dict.fromkeys([0, 1, 2, 3, 10], "T\nCopied text"), 7: "Kept\nAlso kept", 8: "Free text", 9: "Off the template", 11: "m"}


def test_language_and_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = L.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.99
    code = L.codewords(4)
    assert code.shape == (4, 7) and min((a != b).sum() for a, b in itertools.combinations(code, 2)) == 4
    many = L.codewords(12)
    assert min((a != b).sum() for a, b in itertools.combinations(many, 2)) >= 6
    scored = toxicity.score_held_out(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([np.mean([r["predicted"] == y for r in scored if r["toxic"] == y]) for y in (0, 1)])
    assert right >= 0.9
