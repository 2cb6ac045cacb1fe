"""Readers and sinks, and clusters of a small unit from names to written lines."""

import json
import random

import pytest
from pyspark.sql import functions as F

from modsplit_spark.functions import identifiers as I
from modsplit_spark.operators import export as D
from modsplit_spark.operators import graph as G
from modsplit_spark.operators import partition as N
from modsplit_spark.operators import similarity as M
from modsplit_spark.sources import tables

UNIT = "commit_key string, parent_id string"


def test_readers(spark):
    raw = spark.createDataFrame([(b"\x01\xab", None, "a.py", "File", 0), (b"\x02", b"\x01\xab", "f", "Function", 7)], "id binary, parent_id binary, name string, kind string, start_byte int")
    assert [tuple(r) for r in tables.entities_from(raw).orderBy("entity_id").collect()] == [("01ab", None, "a.py", "File", 0), ("02", "01ab", "f", "Function", 7)]
    deps = spark.createDataFrame([(b"\x02", b"\x01\xab", "Call", ""), (b"\x02", b"\x02", "Use", "c1")], "src binary, tgt binary, kind string, commit_id string")
    assert [tuple(r) for r in tables.deps_from(deps).orderBy("kind").collect()] == [("02", "01ab", "Call", None), ("02", "02", "Use", "c1")]
    assert tables.deps_from(deps.limit(0)).collect() == []


def test_sinks(spark, tmp_path):
    rows = [("w", f"u{k}/x", i, f"e{i}", f"n{i}", [k, i % 2]) for k in range(4) for i in range(5)]
    made = spark.createDataFrame(rows, f"{UNIT}, ix int, entity_id string, name string, path array<int>")
    lines, trees, one, doc = (str(tmp_path / x) for x in ("lines", "trees", "one", "doc"))
    tables.write_assignments(made, lines)
    tables.write_documents(D.tree_json(made), trees)
    back = spark.read.parquet(lines)
    assert back.count() == 20 and {r["line"] for r in back.where("parent_id = 'u3/x' and ix = 1").collect()} == {"n1 : [3, 1]"}
    tables.export_unit(back, "w", "u2/x", one)
    assert [r["value"] for r in spark.read.text(one).collect()] == [f"n{i} : [2, {i % 2}]" for i in range(5)]
    tables.export_unit(spark.read.parquet(trees), "w", "u1/x", doc)
    assert json.loads(spark.read.text(doc).first()["value"])["name"] == "u1/x"
    with pytest.raises(Exception, match="exists"):
        tables.write_assignments(made, lines)


def _plain_paths(order, directed, edges):
    """Paths of nodes 0.. (each its own strong component, in topological ``order``) by the sweep, one component at a time."""
    rank = {v: i for i, v in enumerate(order)}
    own = {v: {v} for v in order}
    for a, b in directed:
        if own[a] is not own[b]:
            own[a] |= own[b]
            for x in own[b]:
                own[x] = own[a]
    tops = sorted({max(rank[x] for x in own[v]) for v in order}, reverse=True)
    out = {}
    for top in tops:
        members = sorted((v for v in order if max(rank[x] for x in own[v]) == top), key=rank.get)
        inner = [(min(rank[a], rank[b]), max(rank[a], rank[b]), w) for (a, b), w in edges.items() if a in members and b in members]
        touched = [v for v in members if any(rank[v] in e[:2] for e in inner)]

        def cut(p, inner=inner):
            return sum(round(w * 65536) for lo, hi, w in inner if lo <= p < hi)

        def split(block, path):
            n = len(block)
            bound = -(-1.1 * -(-n // 2) // 1)
            good = [(cut(rank[block[k]]), abs(2 * (k + 1) - n), rank[block[k]], k) for k in range(n - 1) if k + 1 <= bound and n - k - 1 <= bound]
            if n < 2 or not good:
                out.update({v: path for v in block})
                return
            k = min(good)[3]
            split(block[: k + 1], [*path, 0])
            split(block[k + 1 :], [*path, 1])

        out.update({v: [tops.index(top)] for v in members})
        split(touched, [tops.index(top)])
    return out


def test_clusters_from_names_and_dependencies(spark):
    names = ["parseFile", "parsingFiles", "parsed_file", "writeKey", "writesKeys", "drawArray", "draws_arrays", "displayAll"]
    rows = [("w", "u", f"e{i}", n, i, False) for i, n in enumerate(names)]
    nodes = G.index_nodes(spark.createDataFrame(rows, f"{UNIT}, entity_id string, name string, start_byte int, is_client boolean"))
    deps = [(0, 3), (1, 3), (2, 4), (3, 5), (4, 6), (5, 7), (6, 7)]
    directed = spark.createDataFrame([("w", "u", a, b) for a, b in deps], f"{UNIT}, a int, b int")
    termed = I.termize(spark.createDataFrame([("u", f"e{i}", n) for i, n in enumerate(names)], "parent_id string, entity_id string, name string"))
    assert len({r["doc"] for r in termed.collect()}) == 4  # inflections of one name are one document
    sims = M.entity_sim(M.doc_similarity(M.drop_isolated_terms(M.pair_counts(I.occurrences(termed)))))
    similar = G.similarity_edges(nodes, termed, sims)
    got = {r["ix"]: r["path"] for r in N.cluster_units(nodes, directed, similar, exact_nodes=0, refine=False).collect()}
    scc = {r["ix"]: r["scc"] for r in G.strong_components(nodes, directed).collect()}
    edges = {(a, b): 1.0 for a, b in deps}
    for r in similar.collect():
        edges[r["a"], r["b"]] = edges.get((r["a"], r["b"]), 0.0) + r["sim"]
    order = sorted(scc, key=scc.get)
    assert got == _plain_paths(order, deps, edges)
    tree = json.loads(D.tree_json(N.assign_clusters(nodes, G.strong_components(nodes, directed), N.partition_dag(*_condensed(nodes, directed, similar)))).first()["json"])
    assert tree["structure"] and tree["name"] == "u"


def _condensed(nodes, directed, similar):
    edges = G.edge_weights(directed, similar)
    scc = G.strong_components(nodes, directed)
    return G.condense_nodes(nodes, scc), G.condense_edges(edges, scc)


def test_sweep_against_the_least_cut(spark):
    """The first exact split is the least cut of all valid ones; that of the sweep is never below, and not half as much over."""
    rng = random.Random(8)
    graphs = {}
    for k in range(30):
        n = rng.randrange(5, 11)
        graphs[f"u{k}"] = n, sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(2 * n)})
    nodes = spark.createDataFrame([("w", u, 0, i, 1) for u, (n, _) in graphs.items() for i in range(n)], f"{UNIT}, wcc int, pos int, weight int")
    edges = spark.createDataFrame([("w", u, 0, a, b, 1.0) for u, (_, es) in graphs.items() for a, b in es], f"{UNIT}, wcc int, a int, b int, w double")
    labels = {(r["parent_id"], r["pos"]): r["label"] for r in N.acyclic_bisect(N.cut_curve(nodes, edges).withColumn("path", F.array().cast("array<int>"))).collect()}
    exact = {(r["parent_id"], r["pos"]): r["path"] for r in N.recursive_partition(nodes, edges, exact_nodes=12).collect()}
    assert set(exact) == set(labels)
    found = least = 0
    for u, (_, es) in graphs.items():
        members = [p for (v, p) in labels if v == u]
        bound = -(-1.1 * -(-len(members) // 2) // 1)
        own = sum(labels[u, a] != labels[u, b] for a, b in es)
        best = 10**9
        for mask in range(1, (1 << len(members)) - 1):
            side = {v: mask >> i & 1 for i, v in enumerate(members)}
            ones = mask.bit_count()
            if max(ones, len(members) - ones) <= bound and all(side[a] <= side[b] for a, b in es):
                best = min(best, sum(side[a] != side[b] for a, b in es))
        assert own >= best and best == sum(exact[u, a][0] != exact[u, b][0] for a, b in es)
        found, least = found + own, least + best
    assert found <= 1.5 * least, (found, least)


def test_readers_reject_rows(spark):
    schema = "id binary, parent_id binary, name string, kind string, start_byte int, extra int"
    rows = [(b"a", None, "f", "File", 0, 1), (b"b", b"a", "g", "Class", 1, 1), (b"b", b"a", "g", "Class", 1, 1), (b"b", b"a", "h", "Class", 0, 1), (None, None, "n", "File", 0, 1), (b"c", None, "x", "Odd", 0, 1), (b"d", None, "x", None, 0, 1)]
    good, bad = tables.read_entities(spark.createDataFrame(rows, schema), ["File", "Class"])
    assert sorted(tuple(r) for r in good.collect()) == [("61", None, "f", "File", 0), ("62", "61", "h", "Class", 0)]
    assert sorted((str(r["entity_id"]), r["name"], r["reason"]) for r in bad.collect()) == [("62", "g", "repeated_id"), ("62", "g", "repeated_id"), ("63", "x", "unknown_kind"), ("64", "x", "unknown_kind"), ("None", "n", "null_id")]
    deps = spark.createDataFrame([(b"a", b"b", "Call", "c"), (b"a", b"b", "Call", "c"), (None, b"b", "Use", ""), (b"a", b"b", "Use", None)], "src binary, tgt binary, kind string, commit_id string")
    good, bad = tables.read_deps(deps)
    assert good.count() == 3 and [r["reason"] for r in bad.collect()] == ["null_end"]
    assert tables.read_deps(deps, "c")[0].count() == 2 and tables.read_deps(deps, None)[0].count() == tables.read_deps(deps, "")[0].count() == 1
    with pytest.raises(ValueError, match="name .missing"):
        tables.read_entities(spark.createDataFrame([(b"a",)], "id binary"))
    with pytest.raises(ValueError, match="start_byte"):
        tables.read_entities(spark.createDataFrame([], schema.replace("start_byte int", "start_byte string")))


def test_the_commit_filter_reaches_the_files(spark, tmp_path):
    spark.createDataFrame([(b"a", b"b", "Call", f"c{i}") for i in range(3)], "src binary, tgt binary, kind string, commit_id string").write.parquet(f"{tmp_path}/deps.parquet")
    good, _ = tables.read_deps(tables.read_store(spark, "deps", str(tmp_path)), "c1")
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(commit_id,c1)" in plan and good.count() == 1
    with pytest.raises(ValueError, match="one of"):
        tables.read_store(spark, "deps")


def test_a_commit_is_written_anew_alone(spark, tmp_path):
    rows = lambda c, n: spark.createDataFrame([(c, f"u{k}", i, f"line {n}") for k in range(6) for i in range(4)], f"{UNIT}, ix int, line string")
    path = f"{tmp_path}/lines"
    tables.write_by_commit(rows("a", 1).union(rows("b", 1)), path, "ix")
    files = lambda c: {f.name: f.stat().st_mtime_ns for f in (tmp_path / "lines" / f"commit_key={c}").iterdir()}
    a, b = files("a"), files("b")
    tables.write_by_commit(rows("b", 2), path, "ix")
    assert files("a") == a and not files("b").keys() & b.keys() - {".crc"}
    back = spark.read.parquet(path)
    assert {(r["commit_key"], r["line"]) for r in back.collect()} == {("a", "line 1"), ("b", "line 2")} and back.count() == 48
    unit = back.where("commit_key = 'b' and parent_id = 'u3'")
    assert "PartitionFilters: [isnotnull(commit_key" in unit._jdf.queryExecution().executedPlan().toString() and unit.count() == 4
    assert all("commit_key=b" in f for f in unit.inputFiles()) or len(unit.inputFiles()) <= len(back.inputFiles())


def test_fragments_are_the_documents(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for u in range(5):
        for i in range([5, 1, 30, 12, 30][u]):
            path = [rng.randrange(2) for _ in range(rng.randrange(5))] if u else []
            rows.append(("w", f"u{u}", i, f"e{i}", ("(Client) " if rng.random() < 0.3 else "") + rng.choice(['a"b', "c", "d\n"]), path))
    rows += [("w", "only", 0, "e0", "(Client) z", []), ("w", "only", 1, "e1", "(Client) y", [])]
    made = spark.createDataFrame(rows, f"{UNIT}, ix int, entity_id string, name string, path array<int>")
    deps = spark.createDataFrame([("w", r[1], f"e{rng.randrange(9)}", r[3], rng.choice("xy")) for r in rows], f"{UNIT}, src_id string, tgt_id string, kind string")
    counts = D.dependency_counts(deps, made)
    for fragments, whole in ((D.tree_fragments(made), D.tree_json(made)), (D.dependency_fragments(made, counts), D.dependency_json(made, counts))):
        texts = {}
        for r in sorted(fragments.collect(), key=lambda r: (r["parent_id"], r["key"])):
            texts[r["parent_id"]] = texts.get(r["parent_id"], "") + r["text"]
        want = {r["parent_id"]: json.loads(r["json"]) for r in whole.collect()}
        assert {u: json.loads(t) for u, t in texts.items()} == want and len(want) > 2
    path = f"{tmp_path}/trees"
    tables.write_fragments(D.tree_fragments(made), path)
    tables.export_fragments(spark.read.parquet(path), "w", "only", f"{tmp_path}/one")
    parts = sorted((tmp_path / "one").glob("part-*"))
    assert len(json.loads("".join(p.read_text() for p in parts).replace("\n", ""))["structure"]) == 2


def test_no_fragment_grows_with_its_unit(spark):
    n = 3000
    nodes = spark.range(n).selectExpr("'w' AS commit_key", "'u' AS parent_id", "CAST(id AS INT) AS ix", "concat('e', id) AS entity_id", "concat('n', id) AS name", "array(CAST(id % 3 AS INT)) AS path")
    cells = spark.range(60).crossJoin(spark.range(n).withColumnRenamed("id", "b")).selectExpr("'w' AS commit_key", "'u' AS parent_id", "CAST(id AS INT) AS src", "CAST(b AS INT) AS dest", "'k' AS kind", "1.0D AS count")
    for fragments, least in ((D.dependency_fragments(nodes, cells), 60 * n), (D.tree_fragments(nodes), n)):
        got = fragments.agg(F.count("*").alias("n"), F.max(F.length("text")).alias("most")).first()
        assert got["n"] > least and got["most"] < 200


def test_posting_blocks(spark, tmp_path):
    from modsplit_spark.operators import clustering as C

    rows = [("k", f"e{i:04}", ["r"] if i % 2 else ["r", f"s{i % 5}"]) for i in range(900)] + [("other", "e0001", ["r"])]
    wide = C.expand(spark.createDataFrame(rows, "clustering_id string, entity string, path array<string>"))
    blocks = C.entities_blocks(wide, 64)
    whole = {(r["clustering_id"], "$".join(r["path"])): r["entities"] for r in C.entities_for(wide).collect()}
    joined = {}
    for r in sorted(blocks.collect(), key=lambda r: r["block"]):
        assert len(r["members"]) <= 64
        joined.setdefault((r["clustering_id"], "$".join(r["path"])), []).extend(r["members"])
    assert joined == whole and len(whole["k", "r"]) == 900
    C.write_blocks(blocks, f"{tmp_path}/blocks")
    found = C.look_up(spark, f"{tmp_path}/blocks", "k", "r$s2")
    assert sorted(r["member"] for r in found.collect()) == whole["k", "r$s2"]
    assert "EqualTo(key,r$s2)" in found._jdf.queryExecution().executedPlan().toString()
