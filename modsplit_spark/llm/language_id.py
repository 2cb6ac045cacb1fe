"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits. For each bit one binary logistic classifier on hashed
byte n-gram frequencies predicts it. A text's n-gram scores are decoded to the codeword with the
least sum of logistic losses, each bit weighted by how well its classifier did on its sample;
when the runner-up is close, the prediction is flagged as ambiguous.

The classifiers are fitted on at most ``per_label`` texts a language (whole texts, chosen by hash of
the id from the rows that may be learnt from); everything else covers all rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modsplit_spark.llm.bytegrams import grams, joined, parts, slices
from modsplit_spark.llm.sampling import fold, sample_ids

SIZES = range(1, 4)
BUCKET_BITS = 12
UNKNOWN = "und"


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """``k`` rows of +1/-1. Up to 5 languages: every split of them in two, once. More: of many
    random codes of 6 log2(k) + 10 bits the one with the greatest least distance."""
    if k <= 5:
        bits = max(1, 2 ** (k - 1) - 1)
        return np.array([[1 if i == 0 or (b >> (i - 1)) & 1 == 0 else -1 for b in range(1, bits + 1)] for i in range(k)], np.float64)
    rng, best = np.random.default_rng(seed), (-np.inf, None)
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (k, 10 + 6 * int(np.ceil(np.log2(k)))))
        code = code[:, np.abs(code.sum(axis=0)) < k]
        dots = code @ code.T - 2 * code.shape[1] * np.eye(k)
        best = max(best, (-dots.max(), code), key=lambda x: x[0])
    return best[1]


def frequencies(texts: list[bytes]) -> np.ndarray:
    """Relative frequencies of each text's n-gram buckets, one block of buckets for every n."""
    out = np.zeros((len(texts), len(SIZES) << BUCKET_BITS), np.float32)
    for i, t in enumerate(texts):
        a, _ = joined([t])
        for j, (_, g) in enumerate(grams(a, SIZES, BUCKET_BITS)):
            if len(g):
                out[i, j << BUCKET_BITS : (j + 1) << BUCKET_BITS] = np.bincount(g, minlength=1 << BUCKET_BITS) / len(g)
    return out


def fit_bits(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 200) -> dict:
    """Weights (features x bits), biases and bit weights; ``y`` has each row's language as an index."""
    target = code[y]
    scale = (1 / (x.std(axis=0) + 1e-3)).astype(np.float32)
    z = (x * scale).astype(np.float32)
    # One text in five is kept back, to weigh the bits by how often they are right.
    back = np.arange(len(y)) % 5 == 4
    if len(y) < 50 or len(np.unique(y[~back])) < len(np.unique(y)):
        back[:] = False
    z_back, target_back = (z[back], target[back]) if back.any() else (z, target)
    z, target, y = z[~back], target[~back], y[~back]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    counts = np.bincount(y, minlength=len(code))
    weight = (1 / counts[y])[:, None] * len(y) / max(1, (counts > 0).sum())
    for step in range(1, steps + 1):
        f = z @ w + b
        g = (-target * weight / (1 + np.exp(np.clip(target * f, -30, 30))) / len(y)).astype(np.float32)
        gw, gb = z.T @ g + 1e-4 * w, g.sum(axis=0)
        for p, m, v, d in ((w, mw, vw, gw), (b, mb, vb, gb)):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    right = ((z_back @ w + b) * target_back > 0).mean(axis=0)
    return {"w": w * scale[:, None], "b": b, "bit_weight": np.maximum(right - 0.5, 0.05) * 2}


def bit_scores(texts: list[bytes], model: dict) -> np.ndarray:
    """Each text's score for each bit: the mean weight of its n-grams of every n, plus the bias."""
    k = model["w"].shape[1]
    out = np.zeros((len(texts), k))
    for lo, hi in slices(texts):
        a, first = joined(texts[lo:hi])
        for j, (n, g) in enumerate(grams(a, SIZES, BUCKET_BITS)):
            table = model["w"][j << BUCKET_BITS : (j + 1) << BUCKET_BITS]
            # As if each text stood alone between two spaces: its n-grams start at the space before it.
            starts, ends = first[:-1] - 1, np.maximum(first[1:] - n + 1, first[:-1] - 1)
            ends = np.minimum(ends, len(g))
            for i0 in range(0, hi - lo, 64):
                s, e = starts[i0 : i0 + 64], ends[i0 : i0 + 64]
                base = int(s[0])
                sums = np.zeros((int(e.max()) - base + 1, k), np.float64)
                np.cumsum(table[g[base : int(e.max())]], axis=0, dtype=np.float64, out=sums[1:])
                out[lo + i0 : lo + i0 + len(s)] += (sums[e - base] - sums[s - base]) / np.maximum(e - s, 1)[:, None]
    return out + model["b"]


def decode(scores: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword by weighted logistic loss, its share of the evidence, and whether the runner-up is close."""
    code, weight = model["code"], model["bit_weight"]
    loss = (np.logaddexp(0, -code[None, :, :] * scores[:, None, :]) * weight).sum(axis=2)
    best = loss.argmin(axis=1)
    p = np.exp(loss.min(axis=1, keepdims=True) - loss)
    p /= p.sum(axis=1, keepdims=True)
    top = np.sort(p, axis=1)
    close = top[:, -1] < 2 * top[:, -2] if p.shape[1] > 1 else np.zeros(len(p), bool)
    return best, p.max(axis=1), close


def _prepared(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def _featured(batches):
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([frequencies([_prepared(text)])[0].tobytes()])], ["lang", "x"])


def fit(documents: DataFrame, folds: int = 3, held_out: int = 1, per_label: int = 250, in_all: int = 2000) -> dict:
    """The model, from at most ``per_label`` texts a language outside the held-out fold, fewer where there are so many
    languages that it would be over ``in_all`` (one a language at least). Of several rows of one doc_id the least is learnt from."""
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held_out)).select("doc_id", "lang")
    langs = usable.select("lang").distinct().count()
    ids = sample_ids(usable, "lang", max(1, min(per_label, in_all // max(1, langs)))).select("doc_id").distinct()
    rows = documents.select("lang", "text", "doc_id").join(F.broadcast(ids), "doc_id").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row")).select("row.*", "doc_id")
    sample = rows.orderBy("doc_id").select("lang", "text").mapInArrow(_featured, "lang string, x binary").collect()
    if not sample:
        return {"langs": [], "code": np.ones((1, 1)), "w": np.zeros((len(SIZES) << BUCKET_BITS, 1), np.float32), "b": np.zeros(1), "bit_weight": np.ones(1)}
    langs = sorted({r["lang"] for r in sample})
    x = np.frombuffer(b"".join(r["x"] for r in sample), np.float32).reshape(len(sample), -1)
    y = np.array([langs.index(r["lang"]) for r in sample])
    code = codewords(len(langs))
    return {"langs": langs, "code": code} | fit_bits(x, y, code)


def _predicted(batches, model: dict):
    for batch in parts(batches):
        raw = batch.column(1).to_pylist()
        known = np.array([t is not None and any(map(str.isalpha, t)) for t in raw], bool)
        langs, score, unsure = np.full(len(raw), UNKNOWN, object), np.zeros(len(raw)), np.zeros(len(raw), bool)
        at = np.flatnonzero(known)
        if len(at) and model["langs"]:
            best, p, close = decode(bit_scores([_prepared(raw[i]) for i in at], model), model)
            langs[at], score[at], unsure[at] = np.array(model["langs"], object)[best], p, close
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs.tolist(), pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])


def identify(documents: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` for every row, from its whole text.

    ``und`` with score 0 where the text is null or has no letter (or nothing could be learnt).
    Repeated rows stay repeated; other columns are not read."""
    schema = T.StructType([documents.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(partial(_predicted, model=model), schema)


def identify_held_out(documents: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """The digest of ``op8``: predictions of every row by a model that has not learnt from the held-out fold."""
    found = identify(documents, fit(documents, folds, held_out))
    return found.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
