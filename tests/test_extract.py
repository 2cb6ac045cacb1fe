from modsplit_spark.operators import extract as R

SCHEMA = "entity_id string, parent_id string, name string, kind string, start_byte long"


def entities(spark, rows):
    return spark.createDataFrame([(e, p, e, "X", i) for i, (e, p) in enumerate(rows)], SCHEMA)


def test_root_closure_deep_cycle_dangling(spark):
    chain = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 150)]
    odd = [("c1", "c2"), ("c2", "c1"), ("d", "missing"), ("dd", "d")]
    got = {r["entity_id"]: r["root_id"] for r in R.root_closure(entities(spark, chain + odd)).collect()}
    assert got == {f"n{i}": "n0" for i in range(150)}


def test_descend_once_and_units(spark):
    e = entities(spark, [("f", None), ("c", "f"), ("m", "c"), ("g", None), ("h", None), ("h1", "h"), ("h2", "h")])
    assert {(r["root_id"], r["parent_id"]) for r in R.descend_single_child(e).collect()} == {("f", "c"), ("g", "g"), ("h", "h")}
    asked = spark.createDataFrame([("f",), ("g",), ("nope",)], "filename string")
    assert {(r["filename"], r["status"]) for r in R.resolve_units(e, asked).collect()} == {("f", "ok"), ("g", "no_entities"), ("nope", "unknown_file")}


def test_commits(spark):
    deps = spark.createDataFrame([("a", "b", "Call", None), ("a", "b", "Call", ""), ("a", "b", "Use", "ab12")], "src_id string, tgt_id string, kind string, commit_id string")
    assert {r[0] for r in R.list_commits(deps).collect()} == {"WORKDIR", "ab12"}
    assert R.filter_commit(deps, None).count() == 2 and R.filter_commit(deps, "").count() == 2 and R.filter_commit(deps, "ab12").count() == 1
    assert R.resolve_commit(deps).first()["status"] == "ambiguous"
    assert R.resolve_commit(deps.limit(0)).first()["status"] == "no_commits"
    assert tuple(R.resolve_commit(deps.where("commit_id = 'ab12'")).first()) == ("ab12", "ok")


def test_internal_bag_and_clients_distinct(spark):
    e = entities(spark, [("f", None), ("a", "f"), ("b", "f"), ("g", None), ("x", "g"), ("y", "x")])
    deps = spark.createDataFrame([("a", "b", "Call", None)] * 2 + [("a", "a", "Call", None), ("x", "a", "Use", None), ("y", "a", "Use", None)], "src_id string, tgt_id string, kind string, commit_id string")
    assert R.internal_deps(deps, e).where("parent_id = 'f'").count() == 2
    outside = R.outside_deps(deps, e, R.root_closure(e)).where("parent_id = 'f'")
    assert [tuple(r) for r in R.client_deps(outside).collect()] == [("WORKDIR", "f", "g", "a", "Use")]
    assert [r["entity_id"] for r in R.clients(outside, e).collect()] == ["g"]
    units = spark.createDataFrame([("WORKDIR", "f")], "commit_key string, parent_id string")
    assert R.internal_deps(deps, e, units).count() == 2
    labelled = R.label_clients(units, e, R.clients(outside, e)).collect()
    assert {r["name"] for r in labelled} == {"a", "b", "(Client) g"}


def test_root_report(spark):
    """A chain 10,000 deep, one that ends at a missing parent, a cycle of 1,000 with tails, a self-loop."""
    chain = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(10_000)]
    lost = [(f"l{i}", f"l{i - 1}" if i else "gone") for i in range(300)]
    ring = [(f"r{i:04}", f"r{(i + 1) % 1000:04}") for i in range(1000)]
    tail = [(f"a{i}", f"a{i + 1}" if i < 699 else "r0500") for i in range(700)]
    rows = [*chain, *lost, *ring, *tail, ("own", "own"), ("root", None)]
    got = {r["entity_id"]: tuple(r)[1:] for r in R.root_report(spark.createDataFrame(rows, "entity_id string, parent_id string")).collect()}
    want = {i: ("c0", "ok", None) for i, _ in chain} | {i: (None, "dangling", "gone") for i, _ in lost} | {i: (None, "cycle", "r0000") for i, _ in [*ring, *tail]}
    assert got == want | {"own": (None, "cycle", "own"), "root": ("root", "ok", None)}
    assert R.root_report(spark.createDataFrame([], "entity_id string, parent_id string")).collect() == []


def test_children_of_a_giant_parent(spark, monkeypatch):
    from modsplit_spark.operators import ranks

    rows = [(f"e{i}", "p" if i % 9 else "q", f"n{i}", "k", (i * 37) % 500) for i in range(1200)]
    df = spark.createDataFrame(rows, "entity_id string, parent_id string, name string, kind string, start_byte long")
    few = sorted(map(tuple, R.children(df).collect()))
    monkeypatch.setattr(ranks, "GROUP_ROWS", 100)
    kids = R.children(df)
    assert sorted(map(tuple, kids.collect())) == few
    assert "Window" not in kids._jdf.queryExecution().executedPlan().toString()
