import math
import random

from modsplit_spark.operators import similarity as M


def dense(pairs):
    terms, docs = sorted({t for t, _ in pairs}), sorted({d for _, d in pairs})
    s = sum(pairs.values())
    tc = {t: sum(n for (x, _), n in pairs.items() if x == t) for t in terms}
    dc = {d: sum(n for (_, x), n in pairs.items() if x == d) for d in docs}

    def cell(x, a, b):
        return 0.0 if not (x and a and b) else x / s * math.log(x * s / (a * b))

    def mi(t, d):
        n = pairs.get((t, d), 0)
        return cell(n, tc[t], dc[d]) + cell(tc[t] - n, tc[t], s - dc[d]) + cell(dc[d] - n, s - tc[t], dc[d]) + cell(s + n - tc[t] - dc[d], s - tc[t], s - dc[d])

    vec = {d: [mi(t, d) for t in terms] for d in docs}
    out = {}
    for a in docs:
        for b in docs:
            if a <= b:
                ma, mb = sum(vec[a]) / len(terms), sum(vec[b]) / len(terms)
                length = math.sqrt(sum(x * x for x in vec[a])) * math.sqrt(sum(x * x for x in vec[b]))
                out[a, b] = max(0.0, sum((x - ma) * (y - mb) for x, y in zip(vec[a], vec[b], strict=True)) / length) if length else 0.0
    return out


def test_sparse_equals_dense(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for p in range(6):
        pairs = {}
        for _ in range(rng.choice([1, 5, 30])):
            k = (f"t{rng.randrange(8)}", f"d{rng.randrange(7)}")
            pairs[k] = pairs.get(k, 0) + rng.randrange(1, 3)
        rows += [(f"p{p}", t, d, n) for (t, d), n in pairs.items()]
        want |= {(f"p{p}", *k): v for k, v in dense(pairs).items()}
    got = {(r[0], r[1], r[2]): r["sim"] for r in M.doc_similarity(spark.createDataFrame(rows, "parent_id string, term string, doc string, n long")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_isolated_terms_and_top_k(spark):
    rows = [("p", "a", "x", 1), ("p", "a", "y", 1), ("p", "b", "z", 1)]
    pairs = M.drop_isolated_terms(spark.createDataFrame(rows, "parent_id string, term string, doc string, n long"))
    assert {r["doc"] for r in pairs.collect()} == {"x", "y"}
    sims = spark.createDataFrame([("p", "x", "x", 0.9), ("p", "x", "y", 0.2), ("p", "y", "y", 0.8)], "parent_id string, doc_a string, doc_b string, sim double")
    assert M.most_similar(sims, 1).count() == 0
    assert {(r["doc"], r["other"]) for r in M.most_similar(sims, 2).collect()} == {("x", "y"), ("y", "x")}
    assert M.entity_sim(sims).where("sim = 0").count() == 1


def _names(rng, names, words, least=1, most=4):
    """Names of some sub-words, few of them frequent, as pairs of a parent."""
    out = {}
    for i in range(names):
        some = [f"w{min(rng.randrange(words), rng.randrange(words), rng.randrange(words))}" for _ in range(rng.randrange(least, most + 1))]
        doc = "_".join(some)
        for t in [*some, *(f"{a}-{b}" for a, b in zip(some, some[1:], strict=False))]:
            out[t, doc] = out.get((t, doc), 0) + 1
    return out


def test_similar_pairs_are_all_of_them(spark):
    """As the dense vectors have them, whatever finds the candidates: cells, common terms, or both; corpora in which names without a common term are alike too."""
    rng = random.Random(6)
    rows, want, apart = [], {}, 0
    for p in range(14):
        pairs = _names(rng, rng.choice([4, 6, 12, 40]), rng.choice([6, 15, 40]))
        rows += [(f"p{p}", t, d, n) for (t, d), n in pairs.items()]
        terms = {d: {t for t, x in pairs if x == d} for _, d in pairs}
        found = {(f"p{p}", *k): v for k, v in dense(pairs).items() if v >= M.MIN_SIM}
        apart += sum(terms[a].isdisjoint(terms[b]) for _, a, b in found)
        want |= found
    df = spark.createDataFrame(rows, "parent_id string, term string, doc string, n long")
    got = {(r[0], r[1], r[2]): r["sim"] for r in M.similar_pairs(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert apart > 0 and all(a <= b for _, a, b in got)
    v = M._written(M.vectors(df))
    for by_terms in (0.02, 0.24):
        some = {tuple(r) for r in M.candidate_pairs(v, by_terms=by_terms).collect()}
        assert {k for k in want if k[1] != k[2]} <= some
    assert M.similar_pairs(df.limit(0)).collect() == []


def test_few_pairs_of_a_large_parent_are_compared(spark):
    """20,000 names of one parent: under a tenth of all pairs are candidates, in tasks of which none holds the parent."""
    pairs = _names(random.Random(7), 20_000, 6_000, 2, 4)
    df = spark.createDataFrame([("p", t, d, n) for (t, d), n in pairs.items()], "parent_id string, term string, doc string, n long")
    kept = M.drop_isolated_terms(df)
    v = M.Vectors(*(M.materialize(f, "v") for f in M.vectors(kept)))
    names = v.docs.count()
    compared = M.candidate_pairs(v).count()
    print(names, compared, compared / (names * (names - 1) / 2))
    assert names > 18_000 and compared < names * (names - 1) / 20
