"""Texts that repeat a word or a short period over a million times, few words, keys that clash, and columns of any name."""

import hashlib
import random
import zlib

import numpy as np

from modsplit_spark.llm import substring_dedup
from modsplit_spark.llm.wordhash import word_hashes


def test_a_million_equal_words(spark):
    n = 1_100_000
    rows = [(1, "a " * n), (2, "a b " * n), (3, "a " * n + "z"), (4, "y " + "a " * (2 * n)), (5, "own words")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_substrings(frame).collect()}
    # A first text keeps what stands before its second window; a later one its words in no earlier window.
    assert got == {1: (n, n - 1), 2: (2 * n, 2 * n - 2), 3: (n + 1, n), 4: (2 * n + 1, 2 * n), 5: (2, 0)}


def _plain(rows):
    """(words, removed, digest) of rows (id, text) by every window; ids are distinct."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 19):
            key = hash(tuple(w[i : i + 20]))
            if key in seen:
                gone[i : i + 20] = True
            seen.add(key)
        out[d] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_ten_thousand_texts_of_few_words(spark):
    rng = random.Random(21)
    shared = [[rng.choice("abcde") for _ in range(rng.randrange(15, 70))] for _ in range(300)]

    def text():
        w = []
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(6)
            w += [rng.choice("ab") for _ in range(rng.randrange(40))] if k == 0 else [rng.choice("xyz")] * rng.randrange(50) if k == 1 else ["p", "q", "q"] * rng.randrange(15) if k == 2 else [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(30))] if k == 3 else rng.choice(shared)[rng.randrange(9) :]
        return " ".join(w)

    rows = [(i, text()) for i in range(10_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup_substrings(frame).collect()}
    want = _plain(rows)
    assert {d for d in want if got[d] != want[d]} == set() and len(got) == len(rows) and sum(w[1] for w in want.values()) > 50_000


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    for k in (2, 5, 50):
        texts = [" ".join(x for _ in range(40) for x in [f"w{rng.randrange(k)}"] * rng.choice([1, 1, 1, 2, 5])) for _ in range(300)]
        part = [t.split()[9:60] for t in texts]
        texts += [" ".join(["new"] * (i % 4) + w) for i, w in enumerate(part)]
        words, owner, begin, stop, _ = word_hashes([t.encode() for t in texts])
        least, valid, anchored, _ = substring_dedup.anchors(words, owner, stop - begin, [17, 18])
        held = {}
        for i in np.flatnonzero(valid):
            key = tuple(words[i : i + 20].tolist())
            assert held.setdefault(key, (least[i], anchored[i])) == (least[i], anchored[i])


def test_null_ids_with_equal_checksums(spark):
    rest = " ".join(f"w{i}" for i in range(25))
    rows = [(None, f"plumless {rest}"), (None, f"buckeroo {rest}"), (None, None), (None, "")]
    assert zlib.crc32(rows[0][1].encode()) == zlib.crc32(rows[1][1].encode())
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in got) == [(0, 0), (0, 0), (26, 0), (26, 25)]
    named = spark.createDataFrame([("x", rows[0][1]), ("7", rows[1][1])], "doc_id string, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_substrings(named).collect()} == {"x": 0, "7": 25}


def test_columns_of_any_name(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, 1, 2, 3, "a", [4], 0), (2, f"own {long}  end", 1, 2, 3, "b", [5], 0), (3, long, 1, 2, 3, None, None, 0), (4, None, 1, 2, 3, "d", [], 0), (5, "a  b", 1, 2, 3, "e", [], 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, doc int, crc int, hash int, name string, places array<int>, n_chars int")
    kept = substring_dedup.cut_repeats(frame)
    assert kept.schema == frame.schema
    assert sorted((r["doc_id"], r["text"], r["n_chars"], r["name"]) for r in kept.collect()) == [(1, long, 0, "a"), (2, "own end", 7, "b"), (4, None, 0, "d"), (5, "a  b", 9, "e")]
