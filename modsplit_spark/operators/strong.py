"""Strong components of units too large for one task, as a loop of joins, with numbers in topological order.

Each round works on all open subgraphs at once. Nodes without an edge into them come first in their subgraph, nodes without an
edge out of them last; both are components alone. Of the rest every node takes the greatest colour among those that reach it, so that
an edge never leads to a lesser colour: the subgraph falls into the classes of one colour, ordered by it. A class is reached from the
node that gave the colour; what also reaches that node is its component and comes first, the others go on as a new
subgraph. A node's places, one after another, are its key; keys sort topologically.

Colours are drawn anew each round, so a subgraph is expected to fall into parts of half its size at most and rounds grow with the
logarithm of the nodes. To spread colours a node also looks up the colour of the node whose colour it has, which doubles how far
a colour comes in a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modsplit_spark.operators.ranks import running
from modsplit_spark.sources.workspace import materialize, materialize_observed

UNIT = ["commit_key", "parent_id"]
FIRST, MIDDLE, LAST = 0, 1, 2
_NODE_BITS = 31


def _colour(step: int) -> Column:
    """A number that tells nodes of a unit apart and puts them in an order drawn anew for each step."""
    drawn = F.pmod(F.xxhash64(F.lit(step), *UNIT, "ix"), F.lit(1 << 32))
    return F.shiftleft(drawn, _NODE_BITS) + F.col("ix").cast("long")


def _drawn_by(colour: str) -> Column:
    """The node that a colour comes from."""
    return F.col(colour).bitwiseAND(F.lit((1 << _NODE_BITS) - 1)).cast("int")


def _spread(nodes: DataFrame, edges: DataFrame, start: Column, end: Column) -> DataFrame:
    """``(unit, ix, colour)``: the greatest colour among a node and all that reach it by ``edges`` from ``start`` to ``end``."""
    changed = F.count(F.when(F.col("moved"), 1)).alias("moved")
    ends = edges.select(*UNIT, start.alias("_from"), end.alias("ix"))
    now = nodes.select(*UNIT, "ix", "colour")
    while True:
        given = now.select(*UNIT, F.col("ix").alias("_from"), F.col("colour").alias("_given"))
        best = ends.join(given, [*UNIT, "_from"]).groupBy(*UNIT, "ix").agg(F.max("_given").alias("_given"))
        further = now.select(*UNIT, F.col("ix").alias("_at"), F.col("colour").alias("_further"))
        seen = now.withColumn("_at", _drawn_by("colour")).join(further, [*UNIT, "_at"]).join(best, [*UNIT, "ix"], "left")
        top = F.greatest("colour", "_further", F.coalesce("_given", "colour"))
        now, found = materialize_observed(seen.select(*UNIT, "ix", top.alias("colour"), (top > F.col("colour")).alias("moved")), "colours", changed)
        now = now.drop("moved")
        if not found["moved"]:
            return now


def _within(edges: DataFrame, nodes: DataFrame, value: str | None = None) -> DataFrame:
    """The edges between two of ``nodes``, with equal ``value`` if one is named."""
    more = [] if value is None else [F.col(value).alias("_a")]
    left = edges.join(nodes.select(*UNIT, F.col("ix").alias("a"), *more), [*UNIT, "a"])
    right = nodes.select(*UNIT, F.col("ix").alias("b"), *([] if value is None else [F.col(value).alias("_b")]))
    both = left.join(right, [*UNIT, "b"])
    return (both if value is None else both.where("_a = _b")).select(*UNIT, "a", "b")


def component_keys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(unit, ix, root, key)``: ``root`` is one node of the strong component; keys are topological, equal ones come in any order."""
    open_, seen = materialize_observed(nodes.select(*UNIT, F.col("ix").cast("int").alias("ix"), F.array().cast("array<long>").alias("key")).distinct(), "open", F.count("*").alias("n"))
    left = materialize(edges.where("a != b").select(*UNIT, F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")).distinct(), "edges")
    done, step = None, 0
    grown = lambda *places: F.concat("key", F.array(*(p.cast("long") for p in places)))

    def add(found: DataFrame) -> None:
        nonlocal done
        done = found if done is None else done.unionByName(found)

    while seen["n"]:
        step += 1
        into = left.select(*UNIT, F.col("b").alias("ix")).distinct().withColumn("_into", F.lit(True))
        out = left.select(*UNIT, F.col("a").alias("ix")).distinct().withColumn("_out", F.lit(True))
        place = F.when(F.col("_into").isNull(), FIRST).when(F.col("_out").isNull(), LAST).otherwise(MIDDLE)
        placed = materialize(open_.join(into, [*UNIT, "ix"], "left").join(out, [*UNIT, "ix"], "left").select(*UNIT, "ix", "key", place.alias("place")), "placed")
        add(placed.where(F.col("place") != MIDDLE).select(*UNIT, "ix", F.col("ix").alias("root"), grown(F.col("place")).alias("key")))
        inner = placed.where(F.col("place") == MIDDLE).select(*UNIT, "ix", "key")
        left = materialize(_within(left, inner), "edges")
        forward = _spread(inner.withColumn("colour", _colour(step)), left, F.col("a"), F.col("b"))
        coloured = inner.join(forward, [*UNIT, "ix"])
        own = materialize(_within(left, forward, "colour"), "edges")
        # Within a class no colour is over the class's own, so what reaches its node takes that colour backwards.
        back = _spread(inner.withColumn("colour", _colour(step)), own, F.col("b"), F.col("a")).withColumnRenamed("colour", "back")
        judged = materialize(coloured.join(back, [*UNIT, "ix"]).select(*UNIT, "ix", "key", "colour", (F.col("back") == F.col("colour")).alias("found")), "judged")
        add(judged.where("found").select(*UNIT, "ix", _drawn_by("colour").alias("root"), grown(F.lit(MIDDLE), F.col("colour"), F.lit(0)).alias("key")))
        open_, seen = materialize_observed(judged.where("not found").select(*UNIT, "ix", grown(F.lit(MIDDLE), F.col("colour"), F.lit(1)).alias("key")), "open", F.count("*").alias("n"))
        left = materialize(_within(own, open_), "edges")
    return open_.select(*UNIT, "ix", F.col("ix").alias("root"), "key") if done is None else done


def strong_components_loop(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(unit, ix, scc)``: strong components numbered from 0 in a topological order of their unit. No unit is gathered.

    Edges with an end that is no node, and self-loops, don't count; repeated edges count once."""
    keys = materialize(component_keys(nodes, _within(edges, nodes.select(*UNIT, "ix").distinct())), "keys")
    roots = keys.where("ix = root").select(*UNIT, "root", "key")
    numbered = running(roots, UNIT, ["key", "root"], "place").select(*UNIT, "root", (F.col("place") - 1).cast("int").alias("scc"))
    return keys.join(numbered, [*UNIT, "root"]).select(*UNIT, "ix", "scc")
