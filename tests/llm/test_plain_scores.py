"""Scores of op4 and op8 against plain loops over the learnt numbers. The hash of n-grams is stated anew here."""

import math
import random

import numpy as np
import pytest

from modsplit_spark.llm import language_id, toxicity

M = 0xFFFFFFFF
#: Marks that end a word, as characters.
ENDS = set("\x00\t\n\v\f\r ,.;:?\"()[]{}|")
TEXTS = ["", "   ", "a", "You are a f00l, really. Go away!", "Größe und Maß; çok güzel", "x" * 3000, "one two three four five six seven", "(tail) [of] {marks}|", "日本語 テキスト", "mixed\tblank\nlines\r\n end"]


def _bucket(values, bits):
    h = 0
    for v in values:
        h = (h * 0x01000193 + v + 1) & M
    g = ((h ^ (h >> 15)) * 0x9E3779B1 + len(values) * 0x85EBCA6B) & M
    g ^= g >> 13
    return ((g * 0xC2B2AE35) & M) >> (32 - bits)


def _worst_window(text, bucket, bias):
    points = [" ", *text.lower(), " "]
    words, at = [], 0
    while at < len(points):
        if points[at] in ENDS:
            at += 1
            continue
        end = at
        while end < len(points) and points[end] not in ENDS:
            end += 1
        words.append(points[at - 1 : end + 1])
        at = end
    means = []
    for w in words:
        found = [float(bucket[_bucket([ord(c) for c in w[i : i + n]], 17)]) for n in range(3, 8) for i in range(len(w) - n + 1)]
        means.append(sum(found) / max(1, len(found)))
    windows = [means[i : i + 2] for i in range(0, len(means), 2)]
    return max((1 / (1 + math.exp(-(sum(w) / len(w) + bias))) for w in windows), default=0.0)


def test_toxicity_scores_are_means_of_means():
    rng = np.random.default_rng(8)
    model = {"bucket": rng.normal(0, 2, 1 << 17).astype(np.float32), "bias": -0.4}
    got = toxicity.score_texts([t.lower() for t in TEXTS], model)
    assert got == pytest.approx([_worst_window(t, model["bucket"], model["bias"]) for t in TEXTS], abs=1e-5)


def test_toxicity_learns_a_word_and_its_misspelling():
    rng = random.Random(2)
    calm = ["river", "stone", "garden", "window", "letter", "bridge", "market", "silver", "winter", "summer"]
    make = lambda bad: " ".join([rng.choice(calm) for _ in range(20)] + (["blasterfool"] if bad else []))
    labels = [i % 2 for i in range(120)]
    model = toxicity.train([make(x) for x in labels], np.array(labels))
    held = [make(0), make(1), make(0) + " blasterfo0l", make(0) + " " + make(0)]
    assert [int(_worst_window(t, model["bucket"], model["bias"]) >= toxicity.THRESHOLD) for t in held] == [0, 1, 1, 0]
    assert toxicity.score_texts(held, model) == pytest.approx([_worst_window(t, model["bucket"], model["bias"]) for t in held], abs=1e-5)


def _plain_frequencies(text, sizes=(1, 2, 3), bits=12):
    raw = b" " + text + b" "
    out = np.zeros(len(sizes) << bits)
    for j, n in enumerate(sizes):
        found = [_bucket(raw[i : i + n], bits) for i in range(len(raw) - n + 1)]
        for b in found:
            out[(j << bits) + b] += 1 / len(found)
    return out


def test_language_frequencies_bits_and_codewords():
    rng = np.random.default_rng(9)
    texts = [t.lower().encode() for t in TEXTS]
    plain = np.array([_plain_frequencies(t) for t in texts])
    assert np.allclose(language_id.frequencies(texts), plain, atol=1e-6)
    code = language_id.codewords(4)
    model = {"langs": list("abcd"), "code": code, "w": rng.normal(0, 3, (3 << 12, code.shape[1])).astype(np.float32), "b": rng.normal(0, 1, code.shape[1]), "bit_weight": rng.uniform(0.1, 1, code.shape[1])}
    scores = plain @ model["w"].astype(np.float64) + model["b"]
    assert np.allclose(language_id.bit_scores(texts, model), scores, atol=1e-4)
    best, share, close = language_id.decode(scores, model)
    for i, row in enumerate(scores):
        loss = [sum(float(w) * math.log1p(math.exp(-c * f)) for w, c, f in zip(model["bit_weight"], word, row, strict=True)) for word in code]
        odds = sorted((math.exp(min(loss) - x) for x in loss), reverse=True)
        assert best[i] == loss.index(min(loss)) and share[i] == pytest.approx(1 / sum(odds)) and bool(close[i]) == (odds[0] < 2 * odds[1])


def test_bits_of_a_language_are_learnt_from_its_own_letters():
    rng = random.Random(6)
    letters = {"p": "abcdef", "q": "ghijkl", "r": "mnopqr"}
    make = lambda k: " ".join("".join(rng.choice(letters[k]) for _ in range(6)) for _ in range(15))
    names = sorted(letters)
    y = np.array([i % 3 for i in range(90)])
    texts = [make(names[i]).encode() for i in y]
    code = language_id.codewords(3)
    model = {"langs": names, "code": code} | language_id.fit_bits(np.array([_plain_frequencies(t) for t in texts], np.float32), y, code)
    held = [make(k).encode() for k in names for _ in range(5)]
    scores = np.array([_plain_frequencies(t) for t in held]) @ model["w"].astype(np.float64) + model["b"]
    nearest = [min(range(3), key=lambda k: sum(w * math.log1p(math.exp(-c * f)) for w, c, f in zip(model["bit_weight"], code[k], row, strict=True))) for row in scores]
    assert nearest == [k for k in range(3) for _ in range(5)]
    assert language_id.decode(language_id.bit_scores(held, model), model)[0].tolist() == nearest
