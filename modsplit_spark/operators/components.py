"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsplit_spark.sources.workspace import materialize_observed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", by: Sequence[str] = (), max_rounds: int = 60) -> DataFrame:
    """``(*by, node, component)`` for every node with an edge to another node; component = least node.

    Directions are ignored; self-loops, repeated edges and edges with a null end or key are left
    out, so an isolated node has no row. Each round is two aggregations and two joins on the node,
    never a gathered neighbour list, and its result is written to the shared folder, counted as it is
    written. Rounds grow with the logarithm of the component diameter.
    """
    by = list(by)
    whole = F.lit(True)
    for k in (*by, a, b):
        whole = whole & F.col(k).isNotNull()
    ends = edges.where(whole).select(*by, F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    names = [*by, "u", "v"]
    now, mark = materialize_observed(ends.where("u != v").distinct(), "cc", *_mark(names))
    for _ in range(max_rounds):
        both = now.unionByName(now.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*by, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, [*by, "u"]).where("v > u").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        centre = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = large.join(centre, [*by, "u"]).where("v != m").select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        last = mark
        now, mark = materialize_observed(small.unionByName(centre.select(*by, "u", F.col("m").alias("v"))).distinct(), "cc", *_mark(names))
        if last == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = now.select(*by, F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(*by, F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(names: list[str]) -> list[Column]:
    """Count and order-free checksums of the edges: equal marks mean that nothing has changed."""
    hashed = F.xxhash64(*names)
    return [F.count(F.lit(1)).alias("n"), F.sum(hashed.cast("decimal(20,0)")).alias("sum"), F.bit_xor(hashed).alias("xor")]
