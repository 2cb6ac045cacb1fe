"""Splits of components: orders, moves and statuses against all splits of small graphs, and the three ways of recursive_partition."""

import itertools
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from modsplit_spark.operators import partition as N

UNIT = "commit_key string, parent_id string"


def component(n, edges, weights=None):
    """A component as a task sees it; edges (a, b, weight, directed)."""
    rows = [("w", "u", 0, i, w, None, 0, False) for i, w in enumerate(weights or [1] * n)] + [("w", "u", 0, a, 0, b, round(w * N.SCALE), d) for a, b, w, d in edges]
    return N._Component(pd.DataFrame(rows, columns=["commit_key", "parent_id", "wcc", "pos", "weight", "b", "units", "directed"]), N.EPS, N.MIN_WEIGHT)


def graph(rng, n, density, heavy=False):
    pairs = list(itertools.combinations(range(n), 2))
    edges = [(a, b, 1.0 + rng.random() * (rng.random() < 0.3), rng.random() < 0.8) for a, b in rng.sample(pairs, min(len(pairs), int(n * density)))]
    return component(n, edges, [rng.choice([0, 1, 1, 2, 7]) if heavy else 1 for _ in range(n)])


def first_cut(c, split):
    block = list(range(c.n))
    labels = split(c.pos, int(c.weight.sum()))
    if labels is None:
        return None
    assert all(labels[a] <= labels[b] for a, b, d in zip(c.a, c.b, c.directed, strict=True) if d)
    left = sum(int(c.weight[i]) for i in block if labels[i] == 0)
    whole = int(c.weight.sum())
    bound = math.ceil(1.1 * math.ceil(whole / 2))
    assert 1 <= left <= bound and 1 <= whole - left <= bound
    return sum(int(u) for a, b, u in zip(c.a, c.b, c.units, strict=True) if labels[a] != labels[b])


def test_cuts_are_near_the_least():
    """Thirty graphs of 5 to 10 nodes, thirty of 11 and 12: the sum of refined cuts is within a tenth of the least, the sweep's is not."""
    rng = random.Random(30)
    for sizes in (range(5, 11), (11, 12)):
        cuts = []
        for _ in range(30):
            c = graph(rng, rng.choice(list(sizes)), rng.choice([1.2, 1.6, 2.2]))
            cuts.append([first_cut(c, s) for s in (c.exact, c.refined, c.sweep)])
        least, refined, swept = (sum(x) for x in zip(*cuts, strict=True))
        assert least <= refined <= 1.1 * least < swept


def test_no_block_is_closed_that_some_order_could_split():
    rng = random.Random(4)
    closed = 0
    for _ in range(300):
        c = graph(rng, rng.randrange(2, 12), rng.choice([0.6, 1.2, 2.0]), heavy=True)
        if c.weight.sum() >= N.MIN_WEIGHT:
            exact, refined, swept = (first_cut(c, s) for s in (c.exact, c.refined, c.sweep))
            assert (exact is None) == (refined is None)
            closed += refined is not None and swept is None
    assert closed > 3  # one order would have given these up


def test_moves_lower_cuts_of_larger_components():
    """Two clusters whose order interleaves them: no prefix of the order finds the cut between them, moves do."""
    rng = random.Random(2)
    a, b = list(range(0, 120, 2)), list(range(1, 120, 2))
    edges = [(*sorted(rng.sample(side, 2)), 1.0, False) for side in (a, b) for _ in range(240)] + [(x, x + 1, 1.0, True) for x in range(0, 40, 8)]
    c = component(120, edges)
    assert first_cut(c, c.refined) <= 6 * N.SCALE < 40 * N.SCALE < first_cut(c, c.sweep)


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(8)
    nodes, edges = [], []
    for u in range(6):
        n = [3, 9, 12, 20, 45, 60][u]
        nodes += [("w", f"u{u}", 0, i, rng.choice([1, 1, 1, 3])) for i in range(n)]
        edges += [("w", f"u{u}", 0, *sorted(rng.sample(range(n), 2)), 1.0) for _ in range(int(n * 1.6))]
    return spark.createDataFrame(nodes, f"{UNIT}, wcc int, pos int, weight int"), spark.createDataFrame(edges, f"{UNIT}, wcc int, a int, b int, w double")


def test_grouped_and_level_by_level_are_the_same(frames):
    nodes, edges = frames
    key = lambda r: (r["parent_id"], r["pos"])
    grouped = {key(r): (r["path"], r["status"]) for r in N.recursive_partition(nodes, edges).collect()}
    by_levels = {key(r): (r["path"], r["status"]) for r in N.recursive_partition(nodes, edges, group_nodes=0).collect()}
    mixed = {key(r): (r["path"], r["status"]) for r in N.recursive_partition(nodes, edges, group_nodes=12).collect()}
    assert grouped == by_levels == mixed and {s for _, s in grouped.values()} >= {N.LIGHT}
    touched = {(r["parent_id"], x) for r in edges.collect() for x in (r["a"], r["b"])}
    assert grouped.keys() == touched


def test_statuses_say_why_a_block_stays_whole(frames):
    nodes, edges = frames
    weights = {(r["parent_id"], r["pos"]): r["weight"] for r in nodes.collect()}
    for refine in (False, True):
        got = N.recursive_partition(nodes, edges, exact_nodes=12 if refine else 0, refine=refine).collect()
        blocks = {}
        for r in got:
            blocks.setdefault((r["parent_id"], tuple(r["path"])), []).append(r)
        for (unit, _), members in blocks.items():
            weight = sum(weights[unit, r["pos"]] for r in members)
            assert {r["status"] for r in members} == {N.INFEASIBLE if weight >= N.MIN_WEIGHT else N.LIGHT}
            assert len(members) == 1 or weight >= N.MIN_WEIGHT


def test_similarity_can_join_components(spark):
    nodes = spark.createDataFrame([("w", "u", i, 1) for i in range(4)], f"{UNIT}, scc int, weight int")
    edges = spark.createDataFrame([("w", "u", 0, 1, 1.0, True, False), ("w", "u", 2, 3, 1.0, True, False), ("w", "u", 1, 2, 0.5, False, True)], f"{UNIT}, a int, b int, w double, directed boolean, undirected boolean")
    apart = {r["scc"]: r["path"] for r in N.partition_dag(nodes, edges).collect()}
    joined = {r["scc"]: r["path"] for r in N.partition_dag(nodes, edges, similarity_joins=True).collect()}
    assert {p[0] for p in apart.values()} == {0, 1} and {p[0] for p in joined.values()} == {0}
    assert joined == {0: [0, 0], 1: [0, 0, 1], 2: [0, 1, 0], 3: [0, 1, 1]} or {i: p[1] for i, p in joined.items()} == {0: 0, 1: 0, 2: 1, 3: 1}


def test_exact_partition_is_the_least_cut(spark):
    rows = [("w", "u", 0, i, 1) for i in range(4)]
    edges = [("w", "u", 0, a, b, w) for a, b, w in ((0, 1, 1.0), (1, 2, 3.0), (2, 3, 1.0), (0, 3, 1.0))]
    got = N.exact_partition(spark.createDataFrame(rows, f"{UNIT}, wcc int, pos int, weight int"), spark.createDataFrame(edges, f"{UNIT}, wcc int, a int, b int, w double"))
    assert got.where(F.array_contains("path", 0)).count() > 0 and got.columns == ["commit_key", "parent_id", "wcc", "pos", "path"]
