import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from modsplit_spark.functions import paths as P
from modsplit_spark.operators import clustering as C

ROWS = [("k", "e1", []), ("k", "e2", ["a"]), ("k", "e2", ["a", "b"]), ("k", "e3", ["a", "b", "c"]), ("k", "e4", ["b"]), ("k", "e4", ["a", "b"])]


@pytest.fixture(scope="module")
def cl(spark):
    return spark.createDataFrame(ROWS, "clustering_id string, entity string, path array<string>")


def rows(df):
    return {(r["entity"], tuple(r["path"])) for r in df.collect()}


def test_laws(cl):
    assert rows(C.contract(C.expand(cl))) == rows(C.contract(cl))
    assert rows(C.expand(C.expand(cl))) == rows(C.expand(cl))
    some = cl.where(F.size("path") > 0)
    assert {r["entity"] for r in C.normalize(some).collect()} == {"e2", "e3", "e4"}
    rooted = C.with_root(some, ["top", "mid"])
    assert C.root(rooted).first()["root"] == ["top", "mid"]
    assert rows(C.replace_root(rooted, ["top", "mid"])) == rows(rooted)


def test_contract_and_singletons(cl):
    assert rows(C.contract(cl)) == {("e1", ()), ("e2", ("a", "b")), ("e3", ("a", "b", "c")), ("e4", ("b",)), ("e4", ("a", "b"))}
    assert rows(C.without_singletons(cl)) == {("e2", ("a", "b")), ("e3", ("a", "b")), ("e4", ("a", "b"))}


def test_paths(spark, cl):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(["a$b"],)], "path array<string>").select(P.path_validate(F.col("path"))).collect()
    one = spark.createDataFrame([([], ["a"]), ([""], ["a", "b"])], "a array<string>, b array<string>")
    assert [r[0] for r in one.select(P.is_ancestor_of(F.col("a"), F.col("b"))).collect()] == [True, False]
    assert one.select(P.path_equal(F.array().cast("array<string>"), F.array(F.lit("")))).first()[0]
    assert [r[0] for r in one.select(P.path_ancestors(F.col("b"))).collect()] == [[], [["a"]]]
    with pytest.raises(ValueError):
        P.path_truncate(F.col("a"), -2)
    assert rows(C.truncate(cl, -1)) == {(e, ()) for e in ("e1", "e2", "e3", "e4")}


def test_empty(cl):
    none = cl.limit(0)
    for op in (C.expand, C.contract, C.without_singletons, C.normalize, C.root, C.per_level, C.num_levels, C.without_root):
        assert op(none).count() == 0
