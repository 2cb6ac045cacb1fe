"""Blocks that are split side by side against components split one by one."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from modsplit_spark.operators import partition as N

KEY = "commit_key string, parent_id string, wcc int"


def drawn(rng, count):
    """Components of 1 to 40 nodes in order, with weights of which some are 0."""
    for k in range(count):
        n = rng.randrange(1, 40)
        edges = {(a, b): 1.0 + rng.random() * (rng.random() < 0.3) for _ in range(2 * n) for a, b in [sorted((rng.randrange(n), rng.randrange(n)))] if a < b}
        yield k, [rng.choice([0, 1, 1, 1, 3]) for _ in range(n)], edges


def test_rows_in_small_batches_are_split_as_each_component_alone(monkeypatch):
    monkeypatch.setattr(N, "SIDE_ROWS", 50)
    wanted, rows = {}, []
    for k, weights, edges in drawn(random.Random(7), 120):
        parts = [("w", "u", k, i, w, None, 0, False) for i, w in enumerate(weights)] + [("w", "u", k, a, 0, b, round(w * N.SCALE), True) for (a, b), w in edges.items()]
        c = N._Component(pd.DataFrame(parts, columns=["commit_key", "parent_id", "wcc", "pos", "weight", "b", "units", "directed"]), N.EPS, N.MIN_WEIGHT)
        c.run(c.sweep)
        cut = c.curve(np.arange(c.n)) if edges else np.zeros(c.n, np.int64)
        rows += [{"commit_key": "w", "parent_id": "u", "wcc": k, "block": "", "pos": i, "path": [], "weight": w, "cut": int(x)} for i, (w, x) in enumerate(zip(weights, cut, strict=True))]
        wanted |= {(k, i): (p, s == N.INFEASIBLE) for i, (p, s) in enumerate(zip(c.paths, c.status, strict=True))}
    schema = pa.schema([("commit_key", pa.string()), ("parent_id", pa.string()), ("wcc", pa.int32()), ("block", pa.string()), ("pos", pa.int32()), ("path", pa.list_(pa.int32())), ("weight", pa.int64()), ("cut", pa.int64())])
    batches = pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=17)
    out = [r for b in N._sweep_rows(iter(batches), ["commit_key", "parent_id", "wcc", "block"], N.EPS, N.MIN_WEIGHT) for r in b.to_pylist()]
    assert {(r["wcc"], r["pos"]): (r["grown"], r["infeasible"]) for r in out} == wanted and len(out) == len(wanted)
    assert len({s for _, s in wanted.values()}) == 2 and len({len(p) for p, _ in wanted.values()}) > 4


def test_the_sweep_of_small_components_calls_no_function_for_each(spark, monkeypatch):
    comps = list(drawn(random.Random(8), 30))
    nodes = spark.createDataFrame([("w", "u", k, i, w) for k, weights, _ in comps for i, w in enumerate(weights)], f"{KEY}, pos int, weight int")
    edges = spark.createDataFrame([("w", "u", k, a, b, w) for k, _, edges in comps for (a, b), w in edges.items()], f"{KEY}, a int, b int, w double")
    read = lambda df: Counter((r.wcc, r.pos, tuple(r.path), r.status) for r in df.collect())
    ends = edges.selectExpr("commit_key", "parent_id", "wcc", "explode(array(a, b)) AS pos").distinct()
    wanted = read(N.partition_components(nodes.join(ends, ends.columns, "left_semi"), edges))
    monkeypatch.setattr(N, "partition_components", lambda *_: pytest.fail("one call for each component"))
    assert read(N.recursive_partition(nodes, edges)) == wanted
    assert read(N.recursive_partition(nodes, edges, group_nodes=12)) == wanted
