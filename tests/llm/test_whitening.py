"""Whitening against plain loops over all vectors, and its odd tables."""

import math
import random

import numpy as np
import pytest

from modsplit_spark.llm import whitening


def plain(rows):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    v = [[math.fsum((x[i] - s[i] / n) * (x[j] - s[j] / n) for x in fit) / n for j in range(d)] for i in range(d)]
    return kept, n, s, np.array(v)


@pytest.mark.parametrize("d", [1, 3, 9])
def test_against_plain_loops(spark, d):
    rnd = random.Random(d)
    rows = [(i, [rnd.gauss(0, 1 + j) for j in range(d)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(150)] + [(None, rows[8][1]), (9, rows[9][1]), (900, None), (901, [None] * d), (902, [float("nan")] * d), (903, [float("-inf")] + [0.0] * (d - 1))]
    df = spark.createDataFrame([(i, v, 5, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, whitened string").repartition(5)
    got = whitening.whiten(df).collect()
    kept, n, s, v = plain(rows)
    assert len(got) == len(kept) * min(4, d) and {r["n"] for r in got} == {n}
    deviation = {i: sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for i, x in kept}
    assert all(r["deviation"] == deviation[r["vec_id"]] for r in got)
    values, vectors = np.linalg.eigh(v)
    of = dict(kept)
    for k in range(1, min(4, d) + 1):
        mine = sorted((r for r in got if r["component"] == k and r["vec_id"] is not None), key=lambda r: r["vec_id"])
        plain_ = [float((np.array(of[r["vec_id"]]) - np.array(s) / n) @ vectors[:, -k]) / math.sqrt(values[-k]) for r in mine]
        sign = 1 if mine[0]["whitened"] * plain_[0] > 0 else -1
        assert np.allclose([sign * r["whitened"] for r in mine], plain_, atol=1e-7)
        assert all(abs(r["explained"] - values[-k] / np.trace(v)) < 1e-10 and r["identity_error"] < 1e-9 for r in mine)


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [None])], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [])], schema)).collect() == []
    alone = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], schema)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in sorted(alone, key=lambda r: r["component"])] == [(c, 1, 0, None, 0.0) for c in (1, 1, 2, 2)]
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema)).collect()


def test_sums_beyond_64_bits(spark):
    """Sums, counts and deviations stay exact; entries beyond the range count as its end."""
    big = 2.0**54
    rows = [(i, [big - 4096.0 * i, float(i)]) for i in range(40)] + [(50, [1e300, -1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    fitted = whitening.fit(df)
    xs = [[min(max(math.floor(256 * c), -(2**63)), 2**63 - 1) for c in v] for _, v in rows]
    assert (fitted.n, fitted.sums) == (41, [sum(x[j] for x in xs) for j in range(2)])
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.transform(df, fitted).collect()}
    assert got == {i: sum((41 * a - b) ** 2 for a, b in zip(x, fitted.sums, strict=True)) for (i, _), x in zip(rows, xs, strict=True)}


def test_many_partial_matrices(spark):
    """Merging in several levels gives the same fit as merging at once."""
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), float(i % 3)]) for i in range(500)], "vec_id long, embedding array<float>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    try:
        many = whitening.fit(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    one = whitening.fit(df)
    assert (many.n, many.sums) == (one.n, one.sums) == (105, one.sums) and np.allclose(many.values, one.values)
