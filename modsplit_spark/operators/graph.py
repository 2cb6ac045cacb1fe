"""The mixed graph of a unit: nodes, directed and similarity edges, components and the condensation.

A unit is (commit_key, parent_id). Nodes are numbered from 0; edges are ordered pairs ``a, b`` with flags
``directed`` and ``undirected`` and a weight ``w``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modsplit_spark.operators.components import connected_components
from modsplit_spark.operators.ranks import numbered
from modsplit_spark.operators.similarity import both_ways
from modsplit_spark.operators.strong import strong_components_loop
from modsplit_spark.sources.workspace import materialize

UNIT = ["commit_key", "parent_id"]
#: Nodes and edges of a unit up to which one task finds its strong components.
GROUP_ROWS = 500_000
#: Nodes of one name that make a block; the pairs of two blocks are made from one row.
BLOCK = 256


def index_nodes(labelled: DataFrame) -> DataFrame:
    """``labelled`` with ``ix`` (children by start_byte, then clients by name, ties by id) and ``weight``."""
    placed = numbered(labelled, UNIT, ["is_client", "start_byte", "name", "entity_id"], "ix")
    return node_weights(placed.withColumn("ix", F.col("ix").cast("int")))


def node_weights(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("weight", F.when(F.col("is_client"), 0).otherwise(1))


def directed_edges(deps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct ``(unit, a, b)`` of dependencies between two nodes of a unit; no self-loops."""
    src = nodes.select(*UNIT, F.col("entity_id").alias("src_id"), F.col("ix").alias("a"))
    tgt = nodes.select(*UNIT, F.col("entity_id").alias("tgt_id"), F.col("ix").alias("b"))
    return deps.select(*UNIT, "src_id", "tgt_id").join(src, [*UNIT, "src_id"]).join(tgt, [*UNIT, "tgt_id"]).where("a != b").select(*UNIT, "a", "b").distinct()


def similarity_edges(nodes: DataFrame, docs: DataFrame, sims: DataFrame) -> DataFrame:
    """``(unit, a, b, sim)`` with a < b for targets whose names' similarity is over 0. ``docs`` has parent_id, entity_id, doc."""
    targets = nodes.where("not is_client").select(*UNIT, "entity_id", "ix").join(docs.select("parent_id", "entity_id", "doc"), ["parent_id", "entity_id"])
    return block_pairs(_seats(targets.select(*UNIT, "doc", "ix"), UNIT), _near(sims), UNIT)


def _near(sims: DataFrame) -> DataFrame:
    return both_ways(sims.where("sim > 0").select("parent_id", "doc_a", "doc_b", "sim"))


def _seats(named: DataFrame, by: list[str]) -> DataFrame:
    """``named`` (by, doc, ix) with ``block``: numbers for every ``BLOCK`` nodes of a name, in order of ``ix``."""
    return numbered(named, [*by, "doc"], ["ix"], "_place").withColumn("block", F.floor(F.col("_place") / BLOCK).cast("int")).drop("_place")


def block_pairs(seats: DataFrame, near: DataFrame, by: list[str], taken: DataFrame | None = None) -> DataFrame:
    """``(by, a, b, sim)`` of all a < b of ``seats`` (by, doc, ix, block) with similar names, without the pairs of ``taken`` (by, a, b, doc_a,
    block_a, doc_b, block_b). ``near`` has both orders of two names.

    Two blocks of nodes are one row until their pairs are written out, so that only blocks are exchanged, however many pairs they have."""
    blocks = materialize(seats.groupBy(*by, "doc", "block").agg(F.sort_array(F.collect_list("ix")).alias("held")), "blocks")
    left, right = (blocks.select(*by, *(F.col(c).alias(f"{c}_{x}") for c in ("doc", "block", "held"))) for x in "ab")
    both = left.join(near.select("parent_id", "doc_a", "doc_b", "sim"), ["parent_id", "doc_a"]).join(right, [*by, "doc_b"]).where(F.array_min("held_a") < F.array_max("held_b"))
    key = [*by, "doc_a", "block_a", "doc_b", "block_b"]
    free = F.col("held_b")
    if taken is not None:
        ends = taken.groupBy(*key, "a").agg(F.collect_set("b").alias("ends")).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("a", "ends"))).alias("taken"))
        both = both.join(ends, key, "left")
        met = F.try_element_at("taken", F.col("a"))
        free = F.when(met.isNull(), F.col("held_b")).otherwise(F.array_except("held_b", met))
    one = spread(both, *key).select("*", F.explode("held_a").alias("a")).select(*by, "sim", "a", free.alias("free"))
    return one.select(*by, "a", F.explode("free").alias("b"), "sim").where("a < b")


def edge_weights(directed: DataFrame, similar: DataFrame) -> DataFrame:
    """``(unit, a, b, w, directed, undirected)``: 1 for a dependency plus the similarity, for each oriented pair."""
    both = directed.select(*UNIT, "a", "b", F.lit(1.0).alias("w"), F.lit(True).alias("directed"), F.lit(False).alias("undirected")).unionByName(
        similar.select(*UNIT, "a", "b", F.col("sim").alias("w"), F.lit(False).alias("directed"), F.lit(True).alias("undirected"))
    )
    return both.groupBy(*UNIT, "a", "b").agg(F.sum("w").alias("w"), F.max("directed").alias("directed"), F.max("undirected").alias("undirected"))


class Mixed(NamedTuple):
    """The edges of ``mixed_edges``, those of similarity alone as blocks.

    ``seats`` (by, doc, ix, block): the nodes that are one member with a name, called by its ``ix``. ``near`` (parent_id, doc_a, doc_b, sim): similar
    names in both orders. ``taken`` (by, a, b, doc_a, block_a, doc_b, block_b, sim): similar pairs of seats, a < b, that a dependency joins too.
    ``others`` (by, a, b, w, directed, undirected): all edges but those of two seats by similarity alone."""

    by: list[str]
    seats: DataFrame
    near: DataFrame
    taken: DataFrame
    others: DataFrame

    def edges(self, weigh: Callable[[Column], Column] = lambda w: w) -> DataFrame:
        """``(by, a, b, w, directed, undirected)``; ``weigh`` is worked out once for each two names, not for each pair."""
        similar = block_pairs(self.seats, self.near.withColumn("sim", weigh(F.col("sim"))), self.by, self.taken)
        return similar.select(*self.by, "a", "b", F.col("sim").alias("w"), F.lit(False).alias("directed"), F.lit(True).alias("undirected")).unionByName(self.others.withColumn("w", weigh(F.col("w"))))

    def among(self, parts: DataFrame, how: str = "left_semi") -> Mixed:
        """The edges of these ``parts`` (by), or with ``left_anti`` those of the others."""
        return self._replace(**{name: getattr(self, name).join(parts, self.by, how) for name in ("seats", "taken", "others")})


def mixed_edges(members: DataFrame, directed: DataFrame, sims: DataFrame, parts: list[str] | None = None) -> Mixed:
    """Edges between nodes that are sets of members: of every oriented pair the largest weight of an edge between their members, which is 1 for a
    dependency plus the similarity of the names, the latter only from the lesser ``ix`` on. As ``edge_weights`` and ``condense_edges`` of all pairs.

    ``members`` has (unit, parts, node, ix, doc), ``doc`` null where similarity does not count; ``node`` is the least ``ix`` of its set. Edges between two
    ``parts`` are left out."""
    by, near = [*UNIT, *(parts or [])], _near(sims)
    # Members of one name and node are alike but for their places, of which the ends decide whether a pair is in order.
    groups = members.where("doc is not null").groupBy(*by, "node", "doc").agg(F.min("ix").alias("least"), F.max("ix").alias("most"))
    lone = (F.count("*").over(W.partitionBy(*by, "node")) == 1) & (F.col("least") == F.col("most")) & (F.col("least") == F.col("node"))
    groups = materialize(groups.withColumn("lone", lone), "name-groups")
    seats = materialize(_seats(groups.where("lone").select(*by, "doc", F.col("node").alias("ix")), by), "seats")
    placed = materialize(members.select(*by, "node", "ix", "doc").join(seats, [*by, "doc", "ix"], "left"), "placed")
    ends = [placed.select(*(by if x == "a" else UNIT), F.col("ix").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("node", "doc", "block")), *(F.col(c).alias(f"_{c}") for c in by[2:] if x == "b")) for x in "ab"]
    joined = directed.select(*UNIT, "a", "b").join(ends[0], [*UNIT, "a"]).join(ends[1], [*UNIT, "b"])
    for c in by[2:]:
        joined = joined.where(F.col(c) == F.col(f"_{c}")).drop(f"_{c}")
    joined = materialize(joined, "joined")
    met = materialize(joined.where("a < b").join(near, ["parent_id", "doc_a", "doc_b"]), "met")
    taken = met.where("block_a is not null and block_b is not null").select(*by, "a", "b", "doc_a", "block_a", "doc_b", "block_b", "sim")

    def edge(found: DataFrame, a: str, b: str, w: Column, directed: bool, undirected: bool) -> DataFrame:
        return found.select(*by, F.col(a).alias("a"), F.col(b).alias("b"), w.alias("w"), F.lit(directed).alias("directed"), F.lit(undirected).alias("undirected"))

    def similar(one: DataFrame, other: DataFrame) -> DataFrame:
        left = one.select(*by, F.col("node").alias("a"), F.col("doc").alias("doc_a"), F.col("least").alias("_least"))
        right = other.select(*by, F.col("node").alias("b"), F.col("doc").alias("doc_b"), F.col("most").alias("_most"))
        return edge(left.join(near, ["parent_id", "doc_a"]).join(right, [*by, "doc_b"]).where("_least < _most"), "a", "b", F.col("sim"), False, True)

    sets = groups.where("not lone")
    found = edge(joined, "node_a", "node_b", F.lit(1.0), True, False).unionByName(edge(met, "node_a", "node_b", 1 + F.col("sim"), True, True))
    found = found.unionByName(similar(sets, groups)).unionByName(similar(groups.where("lone"), sets))
    others = found.groupBy(*by, "a", "b").agg(F.max("w").alias("w"), F.max("directed").alias("directed"), F.max("undirected").alias("undirected"))
    return Mixed(by, seats, near, taken, others)


def transpose_edges(edges: DataFrame) -> DataFrame:
    return edges.select(*UNIT, F.col("b").alias("a"), F.col("a").alias("b"))


def adjacency(edges: DataFrame) -> DataFrame:
    """``(unit, a, neighbours)`` without self-loops, sorted."""
    return edges.where("a != b").groupBy(*UNIT, "a").agg(F.sort_array(F.collect_set("b")).alias("neighbours"))


def weak_components(nodes: DataFrame, edges: DataFrame, node: str = "ix") -> DataFrame:
    """``(unit, node, wcc)``: components by the edges in either direction, isolated nodes alone, numbered from 0 by
    their largest node, largest first."""
    found = connected_components(edges, "a", "b", by=UNIT).withColumnRenamed("node", node)
    of = nodes.select(*UNIT, node).distinct().join(found, [*UNIT, node], "left").withColumn("component", F.coalesce("component", F.col(node)))
    largest = of.groupBy(*UNIT, "component").agg(F.max(node).alias("largest"))
    ranked = largest.withColumn("wcc", (F.row_number().over(W.partitionBy(*UNIT).orderBy(F.desc("largest"))) - 1).cast("int"))
    return of.join(ranked.drop("largest"), [*UNIT, "component"]).select(*UNIT, node, "wcc")


def _strong(nodes: list[int], out: dict[int, list[int]], into: dict[int, list[int]]) -> dict[int, int]:
    """Kosaraju's two passes with explicit stacks and sorted neighbours; ids in topological order."""
    order, seen = [], set()
    for start in sorted(nodes):
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(out.get(start, ())))]
        while stack:
            node, rest = stack[-1]
            ahead = next((x for x in rest if x not in seen), None)
            if ahead is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(ahead)
                stack.append((ahead, iter(out.get(ahead, ()))))
    component, count = {}, 0
    for start in reversed(order):
        if start in component:
            continue
        component[start], stack = count, [start]
        while stack:
            for x in into.get(stack.pop(), ()):
                if x not in component:
                    component[x] = count
                    stack.append(x)
        count += 1
    return component


def _strong_unit(rows: pd.DataFrame) -> pd.DataFrame:
    edges = rows[rows["b"].notna() & (rows["a"] != rows["b"])]
    out: dict[int, list[int]] = {}
    into: dict[int, list[int]] = {}
    for a, b in sorted({(int(a), int(b)) for a, b in zip(edges["a"], edges["b"], strict=True)}):
        out.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    found = _strong([int(x) for x in rows.loc[rows["b"].isna(), "a"].unique()], out, into)
    return pd.DataFrame({"commit_key": rows["commit_key"].iloc[0], "parent_id": rows["parent_id"].iloc[0], "ix": list(found), "scc": list(found.values())})


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt by their group to several tasks for each core. Groups take long for their bytes, by which Spark would put them together."""
    return rows.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def strong_components(nodes: DataFrame, edges: DataFrame, most_rows: int = GROUP_ROWS) -> DataFrame:
    """``(unit, ix, scc)``: strongly connected components, numbered from 0 in topological order.

    A unit of up to ``most_rows`` nodes and edges is one group, numbered as two depth-first passes with sorted neighbours do. Larger
    units go through the loop of ``strong``, where no group is gathered; they have the same components in a topological order that may be another."""
    rows = nodes.select(*UNIT, F.col("ix").cast("long").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(edges.select(*UNIT, F.col("a").cast("long"), F.col("b").cast("long")))
    sizes = materialize(rows.groupBy(*UNIT).count(), "unit-sizes")
    giant = sizes.where(F.col("count") > most_rows).select(*UNIT)
    if giant.isEmpty():
        return spread(rows, *UNIT).groupBy(*UNIT).applyInPandas(_strong_unit, "commit_key string, parent_id string, ix int, scc int")
    few = spread(rows.join(giant, UNIT, "left_anti"), *UNIT).groupBy(*UNIT).applyInPandas(_strong_unit, "commit_key string, parent_id string, ix int, scc int")
    return few.unionByName(strong_components_loop(nodes.join(giant, UNIT, "left_semi"), edges.join(giant, UNIT, "left_semi")))


def condense_nodes(nodes: DataFrame, scc: DataFrame) -> DataFrame:
    """``(unit, scc, weight, members)``."""
    return nodes.select(*UNIT, "ix", "weight").join(scc, [*UNIT, "ix"]).groupBy(*UNIT, "scc").agg(F.sum("weight").cast("int").alias("weight"), F.sort_array(F.collect_list("ix")).alias("members"))


def condense_edges(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """``(unit, a, b, w, directed, undirected)`` between components: the largest weight of each oriented pair."""
    left = scc.select(*UNIT, F.col("ix").alias("a"), F.col("scc").alias("_a"))
    right = scc.select(*UNIT, F.col("ix").alias("b"), F.col("scc").alias("_b"))
    return edges.join(left, [*UNIT, "a"]).join(right, [*UNIT, "b"]).groupBy(*UNIT, F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.max("w").alias("w"), F.max("directed").alias("directed"), F.max("undirected").alias("undirected"))


def component_edges(edges: DataFrame, wcc: DataFrame, node: str = "scc") -> DataFrame:
    """Edges with both ends in one weak component, with its ``wcc``."""
    left = wcc.select(*UNIT, F.col(node).alias("a"), "wcc")
    right = wcc.select(*UNIT, F.col(node).alias("b"), F.col("wcc").alias("_w"))
    return edges.join(left, [*UNIT, "a"]).join(right, [*UNIT, "b"]).where("wcc = _w").drop("_w")
