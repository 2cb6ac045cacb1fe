"""Cluster trees and dependency matrices, as frames and as one JSON document a unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modsplit_spark.operators.extract import CLIENT
from modsplit_spark.operators.graph import UNIT
from modsplit_spark.operators.ranks import numbered
from modsplit_spark.sources.workspace import materialize

SCHEMA_VERSION = "1.0"


def unique_names(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``unique_name``: the first of equal names as it is, later ones numbered, in node order."""
    again = F.row_number().over(W.partitionBy(*UNIT, "name").orderBy("ix")) - 1
    return nodes.withColumn("_again", again).withColumn("unique_name", F.when(F.col("_again") == 0, F.col("name")).otherwise(F.concat("name", F.lit(" ("), F.col("_again").cast("string"), F.lit(")")))).drop("_again")


def group_name(path: Column) -> Column:
    """``L0/M1/L0``: L and M by turns, with the label of each level."""
    return F.array_join(F.transform(path, lambda c, i: F.concat(F.when(i % 2 == 0, "L").otherwise("M"), c.cast("string"))), "/")


def tree_groups(assignments: DataFrame) -> DataFrame:
    """``(unit, node_path, name, depth, ord)``: one group for each distinct prefix, ``ord`` its first node."""
    some = assignments.where(F.size("path") > 0)
    prefixes = some.select(*UNIT, "ix", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", 1, i))).alias("node_path"))
    return prefixes.groupBy(*UNIT, "node_path").agg(F.min("ix").alias("ord")).select(*UNIT, "node_path", group_name(F.col("node_path")).alias("name"), F.size("node_path").alias("depth"), "ord")


def tree_items(assignments: DataFrame) -> DataFrame:
    """``(unit, node_path, name, ix)``: items under the deepest group of their path; an empty path has none."""
    return unique_names(assignments).where(F.size("path") > 0).select(*UNIT, F.col("path").alias("node_path"), F.col("unique_name").alias("name"), "ix")


def client_root_items(assignments: DataFrame) -> DataFrame:
    """``(unit, name, ix)`` of nodes marked as clients, for the root level."""
    return assignments.where(F.startswith("name", F.lit(CLIENT.strip()))).select(*UNIT, "name", "ix")


def _item(name: Column) -> Column:
    return F.to_json(F.struct(F.lit("item").alias("@type"), name.alias("name")))


def tree_json(assignments: DataFrame, title: Column | None = None) -> DataFrame:
    """``(unit, json)``: the nested cluster tree, built from the deepest level up. A unit's document is one row, so a
    unit is bounded by what a row holds."""
    title = F.col("parent_id") if title is None else title
    groups, items = materialize(tree_groups(assignments), "groups"), materialize(tree_items(assignments), "items")
    deepest = groups.agg(F.max("depth")).first()[0] or 0
    made = None
    for depth in range(deepest, 0, -1):
        own = items.where(F.size("node_path") == depth).select(*UNIT, "node_path", F.col("ix").alias("ord"), F.lit(1).alias("sub"), _item(F.col("name")).alias("json"))
        below = own if made is None else own.unionByName(made.select(*UNIT, F.slice("node_path", 1, depth).alias("node_path"), "ord", F.lit(0).alias("sub"), "json"))
        nested = below.groupBy(*UNIT, "node_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sub", "json"))), lambda x: x["json"]), ",").alias("inner"))
        level = groups.where(F.col("depth") == depth).join(nested, [*UNIT, "node_path"], "left")
        text = F.concat(F.lit('{"@type":"group","name":'), F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(',"nested":['), F.coalesce("inner", F.lit("")), F.lit("]}"))
        made = level.select(*UNIT, "node_path", "ord", text.alias("json"))
    units = assignments.select(*UNIT).distinct()
    top = client_root_items(assignments).select(*UNIT, F.lit(1).alias("sub"), F.col("ix").alias("ord"), _item(F.col("name")).alias("json"))
    if made is not None:
        top = top.unionByName(made.select(*UNIT, F.lit(0).alias("sub"), "ord", "json"))
    inner = top.groupBy(*UNIT).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub", "ord", "json"))), lambda x: x["json"]), ",").alias("inner"))
    quoted = F.to_json(F.array(title))
    whole = F.concat(F.lit(f'{{"@schemaVersion":"{SCHEMA_VERSION}","name":'), quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(',"structure":['), F.coalesce("inner", F.lit("")), F.lit("]}"))
    return units.join(inner, UNIT, "left").select(*UNIT, whole.alias("json"))


def matrix_variables(nodes: DataFrame) -> DataFrame:
    """``(unit, entity_id, name, var_ix)``: nodes in order of name (ties by node order), from 0."""
    placed = numbered(nodes.select(*UNIT, "entity_id", "name", "ix"), UNIT, ["name", "ix"], "var_ix")
    return placed.select(*UNIT, "entity_id", "name", F.col("var_ix").cast("int").alias("var_ix"))


def dependency_counts(deps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(unit, src, dest, kind, count double)``: dependencies between known nodes; repeats count."""
    ix = matrix_variables(nodes)
    src = ix.select(*UNIT, F.col("entity_id").alias("src_id"), F.col("var_ix").alias("src"))
    dest = ix.select(*UNIT, F.col("entity_id").alias("tgt_id"), F.col("var_ix").alias("dest"))
    return deps.select(*UNIT, "src_id", "tgt_id", "kind").join(src, [*UNIT, "src_id"]).join(dest, [*UNIT, "tgt_id"]).groupBy(*UNIT, "src", "dest", "kind").agg(F.count("*").cast("double").alias("count"))


def matrix_cells(counts: DataFrame) -> DataFrame:
    """``(unit, src, dest, values map)``."""
    return counts.groupBy(*UNIT, "src", "dest").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias("values"))


def dependency_json(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """``(unit, json)``: header, variables and cells of each unit's matrix."""
    names = matrix_variables(nodes).groupBy(*UNIT).agg(F.transform(F.array_sort(F.collect_list(F.struct("var_ix", "name"))), lambda x: x["name"]).alias("variables"))
    cells = matrix_cells(counts).groupBy(*UNIT).agg(F.array_sort(F.collect_list(F.struct("src", "dest", "values")), lambda a, b: F.when(a["src"] < b["src"], -1).when(a["src"] > b["src"], 1).when(a["dest"] < b["dest"], -1).when(a["dest"] > b["dest"], 1).otherwise(0)).alias("cells"))
    joined = names.join(cells, UNIT, "left")
    none = F.array().cast("array<struct<src:int,dest:int,values:map<string,double>>>")
    return joined.select(*UNIT, F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("@schemaVersion"), F.col("parent_id").alias("name"), "variables", F.coalesce("cells", none).alias("cells"))).alias("json"))


# ---------------------------------------------------------------- documents as ordered fragments

#: After every key of a group's members.
AFTER = (1 << 63) - 1


def _string(value: Column) -> Column:
    """A JSON string."""
    quoted = F.to_json(F.array(value))
    return quoted.substr(F.lit(2), F.length(quoted) - 2)


def _longs(*values: Column | int) -> Column:
    return F.array(*((F.lit(v) if isinstance(v, int) else v).cast("long") for v in values)).cast("array<long>")


def tree_fragments(assignments: DataFrame, title: Column | None = None) -> DataFrame:
    """``(unit, key array<long>, text)``: the document of ``tree_json`` in pieces. A unit's texts in order of ``key`` are the document; each is a
    header, the opening of a group, an item or a closing, so no row grows with the unit.

    A group's key holds the places of the groups above it and its own; a member's key goes on from it, the closing's with a number after all."""
    title = F.col("parent_id") if title is None else title
    groups = materialize(tree_groups(assignments), "groups")
    above = groups.select(*UNIT, "node_path", F.explode(F.sequence(F.lit(1), F.size("node_path"))).alias("d")).withColumn("_prefix", F.slice("node_path", F.lit(1), F.col("d")))
    steps = above.join(groups.select(*UNIT, F.col("node_path").alias("_prefix"), "ord"), [*UNIT, "_prefix"]).groupBy(*UNIT, "node_path").agg(F.array_sort(F.collect_list(F.struct("d", "ord"))).alias("steps"))
    keyed = groups.join(steps, [*UNIT, "node_path"]).select(*UNIT, "node_path", "name", "ord", F.concat(_longs(0), F.transform("steps", lambda s: 2 * s["ord"].cast("long"))).alias("key"), F.get("steps", F.size("steps") - 2)["ord"].alias("parent_ord"))
    keyed = materialize(keyed, "group-keys")
    top = groups.groupBy(*UNIT).agg(F.min("ord").alias("top"))
    # The first member of a group is the one that gave the group its place.
    comma = lambda place, first: F.when(place == first, "").otherwise(",")
    opened = keyed.join(top, UNIT).select(*UNIT, "key", F.concat(comma(F.col("ord"), F.coalesce("parent_ord", "top")), F.lit('{"@type":"group","name":'), _string(F.col("name")), F.lit(',"nested":[')).alias("text"))
    closed = keyed.select(*UNIT, F.concat("key", _longs(AFTER)).alias("key"), F.lit("]}").alias("text"))
    items = tree_items(assignments).withColumnRenamed("name", "item").join(keyed, [*UNIT, "node_path"])
    items = items.select(*UNIT, F.concat("key", _longs(2 * F.col("ix") + 1)).alias("key"), F.concat(comma(F.col("ix"), F.col("ord")), _item(F.col("item"))).alias("text"))
    clients_ = client_root_items(assignments)
    first = clients_.groupBy(*UNIT).agg(F.min("ix").alias("first")).join(top, UNIT, "left")
    clients_ = clients_.join(first, UNIT).select(*UNIT, _longs(1, F.col("ix")).alias("key"), F.concat(F.when(F.col("top").isNull() & (F.col("ix") == F.col("first")), "").otherwise(","), _item(F.col("name"))).alias("text"))
    units = assignments.select(*UNIT).distinct()
    header = units.select(*UNIT, _longs().alias("key"), F.concat(F.lit(f'{{"@schemaVersion":"{SCHEMA_VERSION}","name":'), _string(title), F.lit(',"structure":[')).alias("text"))
    footer = units.select(*UNIT, _longs(2).alias("key"), F.lit("]}").alias("text"))
    return header.unionByName(opened).unionByName(items).unionByName(closed).unionByName(clients_).unionByName(footer)


def dependency_fragments(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """``(unit, key array<long>, text)``: the document of ``dependency_json`` in pieces, one for each variable and each cell."""
    names = materialize(matrix_variables(nodes), "variables")
    units = names.select(*UNIT).distinct()
    header = units.select(*UNIT, _longs(0).alias("key"), F.concat(F.lit(f'{{"@schemaVersion":"{SCHEMA_VERSION}","name":'), _string(F.col("parent_id")), F.lit(',"variables":[')).alias("text"))
    variables = names.select(*UNIT, _longs(1, F.col("var_ix")).alias("key"), F.concat(F.when(F.col("var_ix") == 0, "").otherwise(","), _string(F.col("name"))).alias("text"))
    middle = units.select(*UNIT, _longs(2).alias("key"), F.lit('],"cells":[').alias("text"))
    cells = materialize(matrix_cells(counts).join(units, UNIT, "left_semi"), "cells")
    first = cells.groupBy(*UNIT).agg(F.min(F.struct("src", "dest")).alias("first"))
    text = F.concat(F.when(F.struct("src", "dest") == F.col("first"), "").otherwise(","), F.to_json(F.struct("src", "dest", "values")))
    cells = cells.join(first, UNIT).select(*UNIT, _longs(3, F.col("src"), F.col("dest")).alias("key"), text.alias("text"))
    footer = units.select(*UNIT, _longs(4).alias("key"), F.lit("]}").alias("text"))
    return header.unionByName(variables).unionByName(middle).unionByName(cells).unionByName(footer)
