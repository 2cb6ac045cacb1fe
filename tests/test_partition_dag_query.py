"""The query partition_dag against its own SQL: columns, and rows of paths of several depths."""

import random
from collections import Counter

import pytest

from modsplit_spark.jobs import registry


def test_partition_dag_has_the_columns_and_rows_of_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng, home = random.Random(21), str(tmp_path)
    parts = [(i, f"Brand#{i % 3}", f"TYPE {i % 4}", f"name{i} word{i % 5}") for i in range(1, 61)]
    lines = [(o, n, rng.randrange(1, 61), 1, "1995-01-01", rng.choice("AN"), rng.choice("FO"), 1, 1) for o in range(80) for n in range(1, 1 + rng.randrange(1, 6))]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_name string").write.parquet(f"{home}/part.parquet")
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate string, l_returnflag string, l_linestatus string, l_quantity long, l_extendedprice long"
    spark.createDataFrame(lines, schema).write.parquet(f"{home}/lineitem.parquet")
    con = duckdb.connect()
    for table in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{home}/{table}.parquet/*.parquet')")
    found = con.execute(registry.oracle_sql()["partition_dag"])
    names, wanted = [c[0] for c in found.description], Counter(found.fetchall())
    got = registry.queries()["partition_dag"](spark, home)
    assert got.columns == names
    assert Counter(map(tuple, got.collect())) == wanted and len({len(p[3]) for p in wanted}) > 3
