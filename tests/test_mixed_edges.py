"""Edges as blocks of names against the edges of all pairs, and the queries that need no pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from modsplit_spark.jobs import registry
from modsplit_spark.operators import graph as G

KEY = "commit_key string, parent_id string"


def frames(spark, seed, nodes=40, names=6, edges=60):
    """Two units of nodes with few names, some of them clients without one, and dependencies with cycles."""
    rng = random.Random(seed)
    units = [("w", "u"), ("c1", "u")]
    docs = [None if i >= nodes - 3 else f"n{rng.randrange(names)}" for i in range(nodes)]
    members = [(*u, f"e{i}", i, i >= nodes - 3, docs[i]) for u in units for i in range(nodes)]
    deps = {(*u, a, b) for u in units for _ in range(edges) if (a := rng.randrange(nodes)) != (b := rng.randrange(nodes - 3))}
    sims = [("u", f"n{i}", f"n{j}", rng.choice([0.0, 0.25, 0.6, 1.0])) for i in range(names) for j in range(i, names)]
    named = spark.createDataFrame(members, f"{KEY}, entity_id string, ix int, is_client boolean, doc string")
    return G.node_weights(named), spark.createDataFrame(sorted(deps), f"{KEY}, a int, b int"), spark.createDataFrame(sims, "parent_id string, doc_a string, doc_b string, sim double")


def all_pairs(named, directed, sims):
    """Every pair of nodes with similar names, in plain Python."""
    near = {(x.doc_a, x.doc_b): x.sim for x in sims.collect() if x.sim > 0}
    near |= {(b, a): s for (a, b), s in near.items()}
    rows = [r for r in named.collect() if r.doc is not None]
    pairs = {(x.commit_key, x.parent_id, x.ix, y.ix): near[x.doc, y.doc] for x in rows for y in rows if x.commit_key == y.commit_key and x.ix < y.ix and (x.doc, y.doc) in near}
    joined = {tuple(r) for r in directed.collect()}
    return {k: ((k in joined) + pairs.get(k, 0.0), k in joined, k in pairs) for k in joined | set(pairs)}


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_edges_of_blocks_are_those_of_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(G, "BLOCK", 3)
    named, directed, sims = frames(spark, seed)
    wanted = all_pairs(named, directed, sims)
    assert sum(d and u for _, d, u in wanted.values()) > 5
    got = G.mixed_edges(named.withColumn("node", F.col("ix")), directed, sims).edges()
    assert rows(got) == Counter({(*k, *v): 1 for k, v in wanted.items()})
    similar = G.similarity_edges(named, named.select("parent_id", "entity_id", "doc").distinct(), sims)
    assert rows(similar.select(*G.UNIT, "a", "b")) == rows(G.edge_weights(directed, similar).where("undirected").select(*G.UNIT, "a", "b"))


@pytest.mark.parametrize("seed", [3, 4])
def test_edges_of_cycles_are_those_of_all_pairs(spark, monkeypatch, seed):
    """Components of one node, of several with one name and with several, as nodes; and only the edges within halves."""
    monkeypatch.setattr(G, "BLOCK", 3)
    named, directed, sims = frames(spark, seed)
    wanted = all_pairs(named, directed, sims)
    scc = {(r.commit_key, r.parent_id, r.ix): r.scc for r in G.strong_components(named, directed).collect()}
    least = {}
    for (c, p, ix), s in sorted(scc.items()):
        least.setdefault((c, p, s), ix)
    of = {k: least[*k[:2], s] for k, s in scc.items()}
    assert 10 < len(least) < 78
    condensed, halves = {}, {}
    for (c, p, a, b), (w, d, u) in wanted.items():
        x, y = of[c, p, a], of[c, p, b]
        for into, key, keep in ((condensed, (c, p, x, y), True), (halves, (c, p, x % 2, x, y), x % 2 == y % 2)):
            if keep:
                old = into.get(key, (0.0, False, False))
                into[key] = (max(old[0], w), old[1] or d, old[2] or u)
    names = spark.createDataFrame([(*k, n, n % 2) for k, n in of.items()], f"{KEY}, ix int, node int, half int")
    members = named.join(names, [*G.UNIT, "ix"])
    assert rows(G.mixed_edges(members, directed, sims).edges()) == Counter({(*k, *v): 1 for k, v in condensed.items()})
    assert rows(G.mixed_edges(members, directed, sims, ["half"]).edges()) == Counter({(*k, *v): 1 for k, v in halves.items()})


def test_pairs_are_written_out_after_the_last_exchange(spark):
    named, directed, sims = frames(spark, 5)
    similar = G.similarity_edges(named, named.select("parent_id", "entity_id", "doc").distinct(), sims)
    plan = similar._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Generate") < plan.index("Exchange")
    mixed = G.mixed_edges(named.withColumn("node", F.col("ix")), directed, sims)
    plan = mixed._replace(others=mixed.others.limit(0)).edges()._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Generate") < plan.index("Exchange")


def test_condensed_nodes_need_no_similarity(spark, tmp_path, monkeypatch):
    home = str(tmp_path)
    spark.createDataFrame([(i, f"Brand#{i % 2}", "T", f"name{i} word") for i in range(1, 21)], "p_partkey long, p_brand string, p_type string, p_name string").write.parquet(f"{home}/part.parquet")
    rng = random.Random(6)
    lines = [(o, n, rng.randrange(1, 21), 1, "1995-01-01", "A", "F", 1, 1) for o in range(20) for n in range(1, 5)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate string, l_returnflag string, l_linestatus string, l_quantity long, l_extendedprice long"
    spark.createDataFrame(lines, schema).write.parquet(f"{home}/lineitem.parquet")
    monkeypatch.setattr(registry.M, "similar_pairs", lambda *_: pytest.fail("names were compared"))
    found = registry.queries()["condense_nodes"](spark, home).collect()
    assert sum(r.members for r in found) == sum(r.weight for r in found) + 2 > len(found)
