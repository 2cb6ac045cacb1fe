"""The split job from requests to written documents."""

import json

import pytest

from modsplit_spark.jobs import split as S

ENTITIES = "entity_id string, parent_id string, name string, kind string, start_byte long"


@pytest.fixture(scope="module")
def store(spark):
    names = ["readFile", "readLine", "writeFile", "writeLine", "parseXml", "parseHtml"]
    entities = [("f", None, "a.py", "File", 0), ("k", "f", "Only", "Class", 1)]
    entities += [(f"m{i}", "k", n, "Method", 10 * i) for i, n in enumerate(names)]
    entities += [("g", None, "b.py", "File", 0), ("g1", "g", "main", "Function", 0), ("g2", "g", "helper", "Function", 5), ("h", None, "empty.py", "File", 0)]
    deps = [("m0", "m1", "Call", ""), ("m2", "m3", "Call", None), ("m4", "m5", "Call", None), ("m1", "m3", "Use", None), ("g1", "m0", "Call", None), ("g1", "m4", "Use", None), ("m0", "m1", "Call", "c1"), ("g1", "g2", "Call", "c1")]
    return spark.createDataFrame(entities, ENTITIES), spark.createDataFrame(deps, "src_id string, tgt_id string, kind string, commit_id string")


def test_from_requests_to_documents(spark, store, tmp_path):
    entities, deps = store
    asked = [("a.py", "WORKDIR"), ("b.py", "c1"), ("empty.py", "c1"), ("none.py", "c1"), ("a.py", "c9"), ("b.py", None)]
    done = S.split_files(entities, deps, spark.createDataFrame(asked, "filename string, commit_key string"))
    statuses = {(r["filename"], r["commit_key"]): r["status"] for r in done.statuses.collect()}
    assert statuses == {("a.py", "WORKDIR"): "ok", ("b.py", "c1"): "ok", ("empty.py", "c1"): "no_entities", ("none.py", "c1"): "unknown_file", ("a.py", "c9"): "unknown_commit", ("b.py", None): "ambiguous"}
    rows = {(r["commit_key"], r["name"]): r for r in done.assignments.collect()}
    assert {k for k in rows} == {("WORKDIR", n) for n in ("readFile", "readLine", "writeFile", "writeLine", "parseXml", "parseHtml", "(Client) b.py")} | {("c1", "main"), ("c1", "helper")}
    # A file of one class is split by the class's members, dependencies only lead on from a first part.
    path = {n: r["path"] for (c, n), r in rows.items() if c == "WORKDIR"}
    assert all(path[a] <= path[b] for a, b in (("readFile", "readLine"), ("writeFile", "writeLine"), ("readLine", "writeLine"), ("parseXml", "parseHtml")) if path[a][0] == path[b][0])
    S.write(done, str(tmp_path / "out"))
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert read("lines").count() == 9 and read("statuses").count() == 6
    for name, part in (("trees", "structure"), ("matrices", "variables")):
        texts = {}
        for r in sorted(read(name).collect(), key=lambda r: (r["commit_key"], r["parent_id"], r["key"])):
            texts[r["commit_key"]] = texts.get(r["commit_key"], "") + r["text"]
        documents = {c: json.loads(t) for c, t in texts.items()}
        assert documents["WORKDIR"]["name"] == "k" and documents["c1"]["name"] == "g" and documents["c1"][part]
    cells = documents["WORKDIR"]["cells"]
    names = documents["WORKDIR"]["variables"]
    assert {(names[c["src"]], names[c["dest"]]): c["values"] for c in cells}["(Client) b.py", "readFile"] == {"Call": 1.0}


def test_the_only_commit_is_taken(spark, store):
    entities, deps = store
    one = S.split_files(entities, deps.where("commit_id = 'c1'"), spark.createDataFrame([("b.py", None)], "filename string, commit_key string"))
    assert [(r["commit_key"], r["status"]) for r in one.statuses.collect()] == [("c1", "ok")] and one.assignments.count() == 2
