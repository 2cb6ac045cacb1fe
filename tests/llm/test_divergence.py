"""The source audit against plain counting, with small blocks, many sources and odd texts."""

import random
import re
from collections import Counter, defaultdict

import pytest

from modsplit_spark.llm import divergence

LETTERS = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


def plain(rows, least, top=10):
    held, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(LETTERS) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        held[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in docs[lang].items() if k >= least]
        sources = [s for g, s in groups if g == lang]
        whole = Counter()
        for s in sources:
            whole.update({t: held[lang, s][t] for t in kept})

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: share(held[lang, s]) for s in sources}, share(whole)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-gap(p[s][t], q[t]), t.encode()) for t in kept if held[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, r + 1) for part, found in (("pair", pairs), ("term", terms)) for r, (v, item) in enumerate(found)]
    return sorted(out)


def run(spark, rows, least=3, **more):
    df = spark.createDataFrame([(i, t, lang, s, 1, 2) for i, (t, lang, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, term int").repartition(5)
    return sorted(tuple(r) for r in divergence.audit(df, min_documents=least, **more).collect())


def corpus(seed, sources, size):
    rnd = random.Random(seed)
    words = [*"abcdefghij", "Ünï", "日本", "x_y", "don't", "ABC", "é" * 40, "w" * 300]
    rows = []
    for _ in range(size):
        some = rnd.sample(words, rnd.randint(1, 9))
        rows.append((rnd.choice([" ", "\n", "1", "-"]).join(rnd.choice(some) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "de", None]), f"s{min(rnd.randrange(sources), rnd.randrange(sources))}"))
    return rows + [(None, "en", "s0"), ("", "fr", None), ("alone", "fr", "s1"), (" 12 ", "it", "s9"), (None, None, None)]


@pytest.mark.parametrize(("sources", "side"), [(4, 256), (30, 256), (30, 4)])
def test_against_plain_counting(spark, sources, side):
    rows = corpus(sources, sources, 400)
    assert run(spark, rows, side=side) == plain(rows, 3)


def test_blocks_and_long_texts(spark, monkeypatch):
    """Texts over a block are read in pieces and count as one document each; blocks of a few texts merge."""
    rows = [*corpus(1, 5, 60), *(("a b a " * 40 + f"t{i} " + "c" * 90, "en", "s1") for i in range(4)), ("q" * 500, "en", "s2")] * 2
    texts = [r[0].encode() for r in rows if r[0]]
    groups = [(b"en", b"s")] * len(texts)
    monkeypatch.setattr(divergence, "BLOCK", 120)
    seen: set = set()
    pieces = [b.to_pydict() for p in divergence._cut(texts[-2]) for b in divergence._records([p], groups[:1], 0, seen)]
    whole = next(iter(divergence._records(texts[-2:-1], groups[:1], 0))).to_pydict()
    docs, counts = Counter(), Counter()
    for p in pieces:
        docs.update(dict(zip(p["term"], p["docs"], strict=True)))
        counts.update(dict(zip(p["term"], p["n"], strict=True)))
    assert len(pieces) > 1 and +docs == Counter(dict(zip(whole["term"], whole["docs"], strict=True))) and +counts == Counter(dict(zip(whole["term"], whole["n"], strict=True)))
    monkeypatch.undo()
    assert run(spark, rows) == plain(rows, 3)


def test_frequent_terms_are_salted(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FREQUENT", 2)
    rows = corpus(2, 6, 300)
    assert run(spark, rows) == plain(rows, 3)


def test_terms_that_share_upper_bits(monkeypatch):
    """Where two terms can't be told apart by the sorted bits the block is sorted in full."""
    texts = [b"b a b a", b"a b", b"", b"a a c"]
    groups = [(b"en", b"s")] * 4
    plain_ = {"a": (3, 5), "b": (2, 3), "c": (1, 1)}
    for mixed in (divergence.mix, lambda h: h & 7 if h.ndim else h):
        monkeypatch.setattr(divergence, "mix", mixed)
        got = next(iter(divergence._records(texts, groups, 0))).to_pydict()
        assert {t: (d, n) for t, d, n in zip(got["term"], got["docs"], got["n"], strict=True)} == plain_ and len(got["term"]) == 3


def test_empty_table(spark):
    assert run(spark, [("a", "b", "c")], least=1) == plain([("a", "b", "c")], 1)
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.audit(df).collect() == []
