"""From requested files to written clusters: the whole way in one job, for any number of files and commits at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modsplit_spark.functions import identifiers as I
from modsplit_spark.operators import export as D
from modsplit_spark.operators import extract as R
from modsplit_spark.operators import graph as G
from modsplit_spark.operators import partition as N
from modsplit_spark.operators import similarity as M
from modsplit_spark.operators.graph import UNIT
from modsplit_spark.sources import tables
from modsplit_spark.sources.workspace import materialize


class Split(NamedTuple):
    """``statuses``: what became of each request. ``assignments``: (unit, ix, entity_id, name, path, status) of the units that are ok.
    ``deps``: their dependencies, clients' lifted to their roots."""

    statuses: DataFrame
    assignments: DataFrame
    deps: DataFrame


def resolve_requests(entities: DataFrame, deps: DataFrame, requests: DataFrame) -> DataFrame:
    """``(filename, commit_key, root_id, parent_id, status)`` of each request (filename, commit_key; a null commit stands for the only one).

    Status is that of the commit (unknown_commit, ambiguous, no_commits) or else of the file (unknown_file, no_entities, ok)."""
    asked = requests.select("filename", "commit_key").distinct()
    only = R.resolve_commit(deps).select(F.col("commit_key").alias("_only"), F.col("status").alias("_only_status"))
    known = R.list_commits(deps).withColumn("_known", F.lit(True))
    # One row, joined by a constant.
    filled = asked.withColumn("_", F.lit(1)).join(only.withColumn("_", F.lit(1)), "_")
    named = filled.withColumn("commit", F.coalesce("commit_key", "_only")).join(known.withColumnRenamed("commit_key", "commit"), "commit", "left")
    of_commit = F.when(F.col("commit_key").isNull(), F.col("_only_status")).when(F.col("_known"), "ok").otherwise("unknown_commit")
    files = R.resolve_units(entities, asked).withColumnRenamed("status", "_file")
    both = named.select("filename", F.col("commit").alias("commit_key"), of_commit.alias("_commit")).join(files, "filename")
    return both.select("filename", "commit_key", "root_id", "parent_id", F.when(F.col("_commit") != "ok", F.col("_commit")).otherwise(F.col("_file")).alias("status"))


def split_files(entities: DataFrame, deps: DataFrame, requests: DataFrame, least_sim: float = M.MIN_SIM, similarity_joins: bool = False) -> Split:
    """Clusters of all requested files. ``requests`` may name any number of files and commits; units without an answer have a status."""
    statuses = materialize(resolve_requests(entities, deps, requests), "requests")
    units = materialize(statuses.where("status = 'ok'").select("commit_key", "parent_id").distinct(), "units")
    kept = deps.withColumn("commit_key", tables.commit_key()).join(units.select("commit_key").distinct(), "commit_key", "left_semi").drop("commit_key")
    own = R.internal_deps(kept, entities, units).join(units, UNIT, "left_semi")
    outside = materialize(R.outside_deps(kept, entities, R.root_closure(entities), units).join(units, UNIT, "left_semi").distinct(), "outside")
    nodes = materialize(G.index_nodes(R.label_clients(units, entities, R.clients(outside, entities))), "nodes")
    found = materialize(own.unionByName(R.client_deps(outside)), "deps")
    members = entities.join(units.select("parent_id").distinct(), "parent_id", "left_semi").select("parent_id", "entity_id", "name")
    termed = materialize(I.termize(members), "terms")
    near = M.similar_pairs(materialize(M.drop_isolated_terms(M.pair_counts(I.occurrences(termed))), "pairs"), least_sim)
    similar = G.similarity_edges(nodes, termed, materialize(near, "sims"))
    assigned = N.cluster_units(nodes, G.directed_edges(found, nodes), similar, similarity_joins=similarity_joins)
    return Split(statuses, materialize(assigned, "assignments"), found)


def write(split: Split, path: str) -> None:
    """``path``/statuses, and by commit ``path``/lines, ``path``/trees and ``path``/matrices, the last two as fragments of documents. A later run of other
    commits leaves these commits' files as they are; statuses are of the last run."""
    split.statuses.write.mode("overwrite").parquet(f"{path}/statuses")
    tables.write_by_commit(tables.assignment_lines(split.assignments), f"{path}/lines", "ix")
    tables.write_fragments(D.tree_fragments(split.assignments), f"{path}/trees")
    tables.write_fragments(D.dependency_fragments(split.assignments, D.dependency_counts(split.deps, split.assignments)), f"{path}/matrices")
