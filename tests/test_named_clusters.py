"""Clusters from names and their similarities against those from all pairs, in tasks and level by level."""

import json
import random
from collections import Counter
from functools import partial

import pytest
from pyspark.sql import functions as F
from test_mixed_edges import frames

from modsplit_spark.jobs import registry
from modsplit_spark.operators import graph as G
from modsplit_spark.operators import partition as N


@pytest.mark.parametrize("group_nodes", [6, N.GROUP_NODES])
def test_clusters_are_those_of_all_pairs(spark, monkeypatch, group_nodes):
    nodes, directed, sims = frames(spark, 9, nodes=60, edges=75)
    nodes = nodes.withColumn("name", F.col("entity_id"))
    docs = nodes.where("not is_client").select("parent_id", "entity_id", "doc").distinct()
    nodes = nodes.drop("doc")
    monkeypatch.setattr(N, "recursive_partition", partial(N.recursive_partition, group_nodes=group_nodes))
    wanted = N.cluster_units(nodes, directed, G.similarity_edges(nodes, docs, sims)).collect()
    monkeypatch.setattr(N, "recursive_partition", lambda *_, **__: pytest.fail("all pairs were made"))
    got = N.cluster_named_units(nodes, directed, docs, sims, group_nodes=group_nodes).collect()
    read = lambda rows: Counter((r.commit_key, r.ix, r.name, tuple(r.path), r.status) for r in rows)
    assert read(got) == read(wanted) and len({len(r.path) for r in wanted}) > 3


def test_trees_need_no_similarity_edges(spark, tmp_path, monkeypatch):
    home, rng = str(tmp_path), random.Random(10)
    spark.createDataFrame([(i, "Brand#1", "T", f"name{i % 3} word") for i in range(1, 16)], "p_partkey long, p_brand string, p_type string, p_name string").write.parquet(f"{home}/part.parquet")
    lines = [(o, n, rng.randrange(1, 16), 1, "1995-01-01", "A", "F", 1, 1) for o in range(8) for n in range(1, 3)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate string, l_returnflag string, l_linestatus string, l_quantity long, l_extendedprice long"
    spark.createDataFrame(lines, schema).write.parquet(f"{home}/lineitem.parquet")
    monkeypatch.setattr(registry.G, "similarity_edges", lambda *_: pytest.fail("all pairs were made"))
    (made,) = registry.queries()["tree_json"](spark, home).collect()
    assert made.json.count('"@type":"item"') == 15 and json.loads(made.json)["name"] == "F:Brand#1"
