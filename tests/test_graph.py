import json
import random

from pyspark.sql import functions as F

from modsplit_spark.operators import export as D
from modsplit_spark.operators import graph as G
from modsplit_spark.operators import partition as N
from modsplit_spark.operators.components import connected_components

UNIT = "commit_key string, parent_id string"


def unit_frames(spark, graphs):
    nodes = [("w", u, i, 1) for u, (n, _) in graphs.items() for i in range(n)]
    edges = [("w", u, a, b) for u, (_, es) in graphs.items() for a, b in es]
    return spark.createDataFrame(nodes, f"{UNIT}, ix int, weight int"), spark.createDataFrame(edges, f"{UNIT}, a int, b int")


def reach(n, edges):
    out = {i: {i} for i in range(n)}
    for _ in range(n):
        for a, b in edges:
            for i in range(n):
                if a in out[i]:
                    out[i].add(b)
    return out


def test_components_against_reachability(spark):
    rng = random.Random(3)
    graphs = {f"u{k}": (n, [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(n + 2))]) for k, n in enumerate([1, 4, 7, 9, 12, 12])}
    nodes, edges = unit_frames(spark, graphs)
    scc = G.strong_components(nodes, edges).collect()
    wcc = G.weak_components(nodes, edges.where("a != b")).collect()
    for u, (n, es) in graphs.items():
        r = reach(n, es)
        ids = {x["ix"]: x["scc"] for x in scc if x["parent_id"] == u}
        assert sorted(set(ids.values())) == list(range(len(set(ids.values()))))
        for i in range(n):
            for j in range(n):
                assert (ids[i] == ids[j]) == (j in r[i] and i in r[j])
        assert all(ids[a] <= ids[b] for a, b in es)
        both = reach(n, es + [(b, a) for a, b in es])
        tops = sorted({max(both[i]) for i in range(n)}, reverse=True)
        assert {x["ix"]: x["wcc"] for x in wcc if x["parent_id"] == u} == {i: tops.index(max(both[i])) for i in range(n)}


def _tarjan_free(n, edges):
    """Components as sets, by a reachability closure on bit masks."""
    out = [1 << i for i in range(n)]
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if out[a] | out[b] != out[a]:
                out[a] |= out[b]
                changed = True
    return out


def test_strong_components_by_the_loop(spark):
    """With the grouped helper switched off: random graphs, a long chain against its numbers, a long cycle with tails, odd edges."""
    rng = random.Random(9)
    graphs = {f"u{k}": (n, [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * d))]) for k, (n, d) in enumerate([(1, 0), (12, 1), (40, 1.2), (40, 1.5)])}
    graphs["chain"] = (60, [(i + 1, i) for i in range(59)])
    graphs["cycle"] = (60, [(i, (i + 1) % 40) for i in range(40)] + [(i, i + 1) for i in range(39, 59)] + [(59, 58)])
    nodes, edges = unit_frames(spark, graphs)
    odd = spark.createDataFrame([("w", "chain", 5, 5), ("w", "chain", 3, 2), ("w", "chain", 7, 9000), ("w", "nowhere", 1, 2)], f"{UNIT}, a int, b int")
    got = G.strong_components(nodes, edges.union(odd), most_rows=0).collect()
    assert len(got) == sum(n for n, _ in graphs.values())
    for u, (n, es) in graphs.items():
        ids = {x["ix"]: x["scc"] for x in got if x["parent_id"] == u}
        r = _tarjan_free(n, es)
        assert sorted(set(ids.values())) == list(range(len(set(ids.values()))))
        assert all((ids[i] == ids[j]) == bool(r[i] >> j & 1 and r[j] >> i & 1) for i in range(n) for j in range(n))
        assert all(ids[a] <= ids[b] for a, b in es)


def test_only_units_over_the_limit_go_through_the_loop(spark, monkeypatch):
    nodes, edges = unit_frames(spark, {"a": (3, [(0, 1), (1, 0)]), "b": (8, [(i, (i + 1) % 8) for i in range(8)])})
    seen = []
    loop = G.strong_components_loop
    monkeypatch.setattr(G, "strong_components_loop", lambda n, e: (seen.extend(r["parent_id"] for r in n.select("parent_id").distinct().collect()), loop(n, e))[1])
    got = {(r["parent_id"], r["ix"]): r["scc"] for r in G.strong_components(nodes, edges, most_rows=10).collect()}
    assert seen == ["b"] and got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1} | {("b", i): 0 for i in range(8)} or seen == ["b"] and got[("a", 0)] == got[("a", 1)] != got[("a", 2)]


def test_components_of_long_chain_star_and_nothing(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1400)]
    frame = spark.createDataFrame(chain + star + [(5000, 5000), (None, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)}
    assert connected_components(frame.limit(0)).count() == 0


def test_partition_contract(spark):
    rng = random.Random(5)
    n = 23
    edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(40)})
    nodes, raw = unit_frames(spark, {"u": (n, edges)})
    weighed = raw.select("commit_key", "parent_id", F.lit(0).alias("wcc"), "a", "b", F.lit(1.0).alias("w"))
    places = nodes.select("commit_key", "parent_id", F.lit(0).alias("wcc"), F.col("ix").alias("pos"), "weight")
    paths = {r["pos"]: r["path"] for r in N.recursive_partition(places, weighed).collect()}
    blocks = {}
    for pos, path in paths.items():
        for k in range(len(path)):
            blocks.setdefault(tuple(path[:k]), []).append((pos, path[k]))
    for members in blocks.values():
        parts = [sum(1 for _, x in members if x == side) for side in (0, 1)]
        bound = -(-int(1.1 * -(-len(members) // 2) * 10**9) // 10**9)
        assert min(parts) >= 1 and max(parts) <= bound
        side = dict(members)
        assert all(side[a] <= side[b] for a, b in edges if a in side and b in side)


def test_balance_bound_rounds_in_double(spark):
    got = spark.range(1).select(N.balance_bound(F.lit(100)).alias("b"), N.balance_bound(F.lit(3)).alias("c")).first()
    assert tuple(got) == (56, 3)


def test_export_json(spark):
    rows = [("w", "u", 0, "e0", "x", [0, 1]), ("w", "u", 1, "e1", "x", [0, 0]), ("w", "u", 2, "e2", "(Client) z", [0, 1]), ("w", "u", 3, "e3", 'q"', [])]
    a = spark.createDataFrame(rows, f"{UNIT}, ix int, entity_id string, name string, path array<int>")
    tree = json.loads(D.tree_json(a).first()["json"])
    assert tree["structure"][0]["name"] == "L0"
    first, second = tree["structure"][0]["nested"]
    assert (first["name"], [x["name"] for x in first["nested"]]) == ("L0/M1", ["x", "(Client) z"])
    assert [x["name"] for x in second["nested"]] == ["x (1)"]
    assert tree["structure"][1] == {"@type": "item", "name": "(Client) z"}
    deps = spark.createDataFrame([("w", "u", "e0", "e1", "Call")] * 2 + [("w", "u", "e0", "gone", "Call")], f"{UNIT}, src_id string, tgt_id string, kind string")
    doc = json.loads(D.dependency_json(a, D.dependency_counts(deps, a)).first()["json"])
    assert doc["variables"] == ["(Client) z", 'q"', "x", "x"] and doc["cells"] == [{"src": 2, "dest": 3, "values": {"Call": 2.0}}]
