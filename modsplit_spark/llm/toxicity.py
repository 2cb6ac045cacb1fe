"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed, with its boundaries), so a
misspelling that was never seen shares most of them with the word it hides. Words are averaged over
windows of ``WINDOW`` words and a linear softmax scores each window; a text's score is that of its
worst window, so that a long text does not dilute an insult. Vectors and softmax are learnt together
from text labels: every window of a clean text is clean; of a toxic text, windows count by how toxic
they look so far.

Fitting uses at most ``per_label`` labelled texts of each kind, whole, chosen by hash of the id.
For scoring, the softmax is folded into one number per n-gram, so a text costs a few array passes.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modsplit_spark.llm.bytegrams import grams, joined_points, parts, slices, words
from modsplit_spark.llm.sampling import fold, sample_ids

SIZES = range(3, 8)
BUCKET_BITS = 17
DIMENSIONS = 8
WINDOW = 2
THRESHOLD = 0.3
MIN_TEXTS = 3
MIN_SHARE = 0.01
DECAY = 1e-5


def _prepared(text: str | None) -> str:
    return (text or "").lower()


def _word_windows(a: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words' ends, the window of each word, and the text of each window."""
    start, end = words(a)
    text = np.searchsorted(first, start, "right") - 1
    count = np.bincount(text, minlength=len(first) - 1)
    rank = np.arange(len(start)) - (np.cumsum(count) - count)[text]
    opens = rank % WINDOW == 0
    return start, end, np.cumsum(opens) - 1, text[opens]


# ---------------------------------------------------------------- fitting


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words as bags of buckets (flat, with offsets), each running word's distinct word and
    window, and each window's text."""
    seen: dict[str, int] = {}
    word_of, window_of, text_of = [], [], []
    for i, t in enumerate(texts):
        a, first = joined_points([t])
        start, end, window, owner = _word_windows(a, first)
        raw = f" {t} "
        for s, e in zip(start.tolist(), end.tolist(), strict=True):
            w = raw[s:e]
            if w not in seen:
                seen[w] = len(seen)
            word_of.append(seen[w])
        window_of.append(window + len(text_of))
        text_of.extend([i] * len(owner))
    flat, offsets = _word_grams(list(seen))
    return flat, offsets, np.array(word_of, np.int64), np.concatenate(window_of) if window_of else np.zeros(0, np.int64), np.array(text_of, np.int64)


def _word_grams(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of each word, from the separator before it to the one after it, and where each word's start."""
    a, first = joined_points(distinct)
    lengths = np.diff(first) - 1
    word_at = np.repeat(np.arange(len(distinct), dtype=np.int32), lengths + 1)  # of the separator before a word and its characters
    words_of, flat = [], []
    for n, g in grams(a, SIZES, BUCKET_BITS):
        at = np.arange(min(len(g), len(word_at)))
        word = word_at[: len(at)]
        whole = at + n <= first[word + 1]
        words_of.append(word[whole])
        flat.append(g[: len(at)][whole])
    word, flat = np.concatenate(words_of), np.concatenate(flat)
    order = np.argsort(word, kind="stable")
    return flat[order], np.searchsorted(word[order], np.arange(len(distinct) + 1))


class _Sums:
    """Sums of rows by key, in sorted passes over ``BLOCK`` rows at a time. Keys must all occur; row ``at[i]`` counts for the i-th key."""

    BLOCK = 1 << 19

    def __init__(self, keys: np.ndarray, at: np.ndarray):
        if not np.all(keys[1:] >= keys[:-1]):
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
        self.at = at.astype(np.int32)
        self.starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        cuts = np.searchsorted(self.starts, np.arange(0, len(keys), self.BLOCK))
        self.cuts = np.unique(np.append(cuts, len(self.starts)))

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.starts), rows.shape[1]), rows.dtype)
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            lo, hi = self.starts[a], self.starts[b] if b < len(self.starts) else len(self.at)
            out[a:b] = np.add.reduceat(rows[self.at[lo:hi]], self.starts[a:b] - lo, axis=0)
        return out


def train(texts: list[str], labels: np.ndarray, epochs: int = 40, seed: int = 5) -> dict:
    """One number per bucket and a bias: the logit of a window is their mean over words of means over n-grams.

    N-grams of fewer than ``MIN_TEXTS`` texts, or ``MIN_SHARE`` of them, say nothing and stay at zero, as unseen ones do. One text in
    five is kept back; on those the bias is set so that the decision threshold lies midway between the two kinds."""
    empty = {"bucket": np.zeros(1 << BUCKET_BITS, np.float32), "bias": -3.0}
    if not len(labels) or labels.min() == labels.max():
        return empty
    back = np.arange(len(texts)) % 5 == 4
    learnt = [t for t, k in zip(texts, back, strict=True) if not k]
    flat, offsets, word_of, window_of, text_of = _bags(learnt)
    y_text = labels[~back]
    if not len(text_of) or y_text.min() == y_text.max():
        return empty
    per_word = np.maximum(np.diff(offsets), 1)[:, None].astype(np.float32)
    n_words, n_texts = len(per_word), len(learnt)
    gram_word = np.repeat(np.arange(n_words, dtype=np.int32), np.diff(offsets))
    # Texts of each bucket: distinct (text, word) pairs carry the word's buckets.
    pairs = np.unique(text_of[window_of] * n_words + word_of)
    texts_of_word = np.bincount(pairs % n_words, minlength=n_words)
    frequent = np.bincount(flat, texts_of_word[gram_word], 1 << BUCKET_BITS)[flat] >= max(MIN_TEXTS, MIN_SHARE * n_texts)
    used, ids = np.unique(flat[frequent], return_inverse=True)
    # Bucket 0 stays zero and stands for what is left out, so that every word has a gram.
    flat = np.concatenate([np.zeros(n_words, np.int32), ids.astype(np.int32) + 1])
    gram_word = np.concatenate([np.arange(n_words, dtype=np.int32), gram_word[frequent]])
    by_word, by_bucket = _Sums(gram_word, flat), _Sums(flat, gram_word)
    by_window, by_running = _Sums(window_of, word_of), _Sums(word_of, window_of)
    del flat, gram_word, ids, frequent, pairs
    window_size = np.bincount(window_of)[:, None].astype(np.float32)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (len(used) + 1, DIMENSIONS)).astype(np.float32), rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)]
    params[0][0] = 0
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    y = y_text[text_of].astype(np.float32)
    in_text = np.bincount(text_of, minlength=n_texts)[text_of]
    share = np.where(y_text == 1, 0.5 / max(1, (y_text == 1).sum()), 0.5 / max(1, (y_text == 0).sum()))[text_of]
    for epoch in range(1, epochs + 1):
        emb, soft, bias = params
        word_vec = by_word(emb) / per_word
        win_vec = by_window(word_vec) / window_size
        logits = win_vec @ soft + bias
        p = 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -30, 30)))
        # Of a toxic text the windows share its weight by their odds; of a clean one equally, the worst counting again.
        odds = p / (1 - p + 1e-6) + 1e-6
        top = np.zeros(n_texts)
        np.maximum.at(top, text_of, p)
        by_odds = odds / np.bincount(text_of, odds, n_texts)[text_of]
        alpha = np.where(y == 1, by_odds, 0.5 / in_text + 0.5 * (p == top[text_of]))
        g = (((p - y) * alpha * share)[:, None] * np.array([[-1.0, 1.0]])).astype(np.float32)
        d_win = (g @ soft.T) / window_size
        d_word = by_running(d_win) / per_word
        grads = [by_bucket(d_word) + DECAY * emb, win_vec.T @ g, g.sum(axis=0)]
        grads[0][0] = 0
        for q, d, (m, v) in zip(params, grads, state, strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            q -= 0.1 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-6)
    emb, soft, bias = params
    bucket = np.zeros(1 << BUCKET_BITS, np.float32)
    bucket[used] = emb[1:] @ (soft[:, 1] - soft[:, 0])
    model = {"bucket": bucket, "bias": float(bias[1] - bias[0])}
    return model | {"bias": model["bias"] + _shift(score_texts([t for t, k in zip(texts, back, strict=True) if k], model), labels[back])}


def _shift(p: np.ndarray, y: np.ndarray) -> float:
    """What to add to logits so that the threshold splits the two kinds with the fewest balanced errors, midway in the gap."""
    if not len(y) or y.min() == y.max():
        return 0.0
    z = np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9)))
    cuts = np.unique(z)
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2])
    wrong = np.array([np.mean(z[y == 1] < c) + np.mean(z[y == 0] >= c) for c in cuts])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    middle = (cuts[best[0]] + cuts[best[-1]]) / 2
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - middle)


def fit(documents: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, per_label: int = 500) -> dict:
    """The model, from at most ``per_label`` texts of each label outside the held-out fold.

    Rows whose doc_id, text or label is null are not learnt from; a doc_id that is labelled twice counts as toxic if once, and of
    several texts of one doc_id the least is learnt, so that the sample is bounded in rows."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out)).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    present = usable.join(documents.where("text is not null").select("doc_id"), "doc_id", "left_semi")
    ids = sample_ids(present, "_toxic", per_label)
    rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "_toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([_prepared(r["text"]) for r in rows], np.array([int(r["_toxic"] == 1) for r in rows], np.int64))


# ---------------------------------------------------------------- scoring


def score_texts(texts: list[str], model: dict) -> np.ndarray:
    """The probability of each text's worst window; 0 for a text without a word."""
    out = np.zeros(len(texts))
    for lo, hi in slices(texts):
        a, first = joined_points(texts[lo:hi])
        start, end, window, owner = _word_windows(a, first)
        if not len(start):
            continue
        total, count = np.zeros(len(start)), np.zeros(len(start))
        for n, g in grams(a, SIZES, BUCKET_BITS):
            sums = np.concatenate([[0.0], np.cumsum(model["bucket"][g], dtype=np.float64)])
            begin = np.minimum(start - 1, len(g))  # n-grams from the separator before a word to the one after it
            stop = np.clip(end + 2 - n, begin, len(g))
            total += sums[stop] - sums[begin]
            count += stop - begin
        logit = total / np.maximum(count, 1)
        logit = np.bincount(window, logit, len(owner)) / np.bincount(window, minlength=len(owner)) + model["bias"]
        p = 1 / (1 + np.exp(np.clip(-logit, -30, 30)))
        np.maximum.at(out, lo + owner, p)
    return out


def _scored(batches, model: dict):
    for batch in parts(batches):
        p = score_texts([_prepared(t) for t in batch.column(1).to_pylist()], model)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])


def score(documents: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row, from its whole text; null and empty texts score 0."""
    schema = T.StructType([documents.schema["doc_id"], T.StructField("score", T.DoubleType())])
    scored = documents.select("doc_id", F.col("text").cast("string")).mapInArrow(partial(_scored, model=model), schema)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def score_held_out(documents: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """The digest of ``op4``: every document scored by a model that has not learnt from the held-out fold."""
    found = score(documents, fit(documents, labels, folds, held_out))
    return found.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def _kept(batches, model: dict):
    for batch in parts(batches):
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        yield batch.filter(pa.array(score_texts([_prepared(t) for t in texts], model) < THRESHOLD))


def keep_clean(documents: DataFrame, model: dict) -> DataFrame:
    """The rows of ``documents``, all columns, whose text scores under the threshold."""
    return documents.mapInArrow(partial(_kept, model=model), documents.schema)
