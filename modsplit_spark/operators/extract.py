"""Members, roots, inner dependencies and clients of all units at once.

``entities`` has entity_id, parent_id, name, kind, start_byte; ``deps`` has src_id, tgt_id, kind, commit_id. A unit is
(commit_key, parent_id). Every operator works on all units; a ``units`` frame restricts it by a semi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modsplit_spark.operators.ranks import numbered
from modsplit_spark.sources.tables import commit_key
from modsplit_spark.sources.workspace import materialize_observed

CLIENT = "(Client) "


def list_commits(deps: DataFrame) -> DataFrame:
    """Distinct ``commit_key``."""
    return deps.select(commit_key().alias("commit_key")).distinct()


def resolve_commit(deps: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """``(commit_key, status)``. Requested keys are ok or unknown_commit; with none requested the only commit is ok,
    several are ambiguous, and no commit gives one row no_commits."""
    known = list_commits(deps)
    if requested is not None:
        mark = known.withColumn("_known", F.lit(True))
        return requested.select("commit_key").distinct().join(mark, "commit_key", "left").select("commit_key", F.when(F.col("_known"), "ok").otherwise("unknown_commit").alias("status"))
    counted = known.agg(F.count("*").alias("n"), F.min("commit_key").alias("commit_key"))
    return counted.select(F.when(F.col("n") == 1, F.col("commit_key")).alias("commit_key"), F.when(F.col("n") == 1, "ok").when(F.col("n") == 0, "no_commits").otherwise("ambiguous").alias("status"))


def filter_commit(deps: DataFrame, commit_id: str | None) -> DataFrame:
    """Dependencies of one commit; null and empty both mean the working directory."""
    return deps.where(F.nullif(F.col("commit_id"), F.lit("")).eqNullSafe(F.lit(commit_id or None).cast("string")))


def list_roots(entities: DataFrame) -> DataFrame:
    """``(name, entity_id)`` of entities without a parent; equal names stay apart."""
    return entities.where("parent_id is null").select("name", "entity_id")


def children(entities: DataFrame) -> DataFrame:
    """Direct children with ``ord``, their rank by start_byte (ties by id) from 0."""
    kids = entities.where("parent_id is not null").select("parent_id", "entity_id", "name", "kind", "start_byte")
    return numbered(kids, ["parent_id"], ["start_byte", "entity_id"], "ord").withColumn("ord", F.col("ord").cast("int"))


def descend_single_child(entities: DataFrame) -> DataFrame:
    """``(root_id, parent_id)``: a root with exactly one child hands over to it, one step only."""
    counts = entities.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n"), F.min("entity_id").alias("child"))
    roots = list_roots(entities).select(F.col("entity_id").alias("root_id"))
    return roots.join(counts, F.col("root_id") == F.col("parent_id"), "left").select("root_id", F.when(F.col("n") == 1, F.col("child")).otherwise(F.col("root_id")).alias("parent_id"))


def resolve_units(entities: DataFrame, requests: DataFrame) -> DataFrame:
    """``(filename, root_id, parent_id, status)`` for each requested ``filename``: ok, unknown_file or no_entities."""
    named = list_roots(entities).join(descend_single_child(entities), F.col("entity_id") == F.col("root_id")).select("name", "root_id", "parent_id")
    has = entities.where("parent_id is not null").select(F.col("parent_id").alias("_p")).distinct()
    found = requests.select("filename").distinct().join(named, F.col("filename") == F.col("name"), "left").join(has, F.col("parent_id") == F.col("_p"), "left")
    status = F.when(F.col("root_id").isNull(), "unknown_file").when(F.col("_p").isNull(), "no_entities").otherwise("ok")
    return found.select("filename", "root_id", "parent_id", status.alias("status"))


def root_report(entities: DataFrame) -> DataFrame:
    """``(entity_id, root_id, status, witness)`` of every entity: ``ok`` with its root; ``dangling`` where the chain of parents ends at a
    missing one, which is the witness; ``cycle`` where it never ends, with the least id of the cycle it runs into.

    Pointers jump as in ``root_closure``, and each carries the least id of what it has passed. When a round settles nothing all that is left runs
    into cycles; once pointers reach further than there are such entities, each has passed its cycle as a whole or stands on it."""
    still = F.count(F.when(F.col("status") == "open", 1)).alias("left")
    status = F.when(F.col("parent_id").isNull(), "ok").otherwise("open")
    first = entities.select("entity_id", F.coalesce("parent_id", "entity_id").alias("ptr"), F.col("entity_id").alias("least"), status.alias("status"))
    now, seen = materialize_observed(first, "report", still)
    left, reach, settled = seen["left"], 1, False
    while left and not (settled and reach > left):
        ahead = now.select(F.col("entity_id").alias("_id"), F.col("ptr").alias("_ptr"), F.col("least").alias("_least"), F.col("status").alias("_status"))
        met = now.where("status = 'open'").join(ahead, F.col("ptr") == F.col("_id"), "left")
        moving = met.select("entity_id", F.coalesce("_ptr", "ptr").alias("ptr"), F.least("least", "_least").alias("least"), F.coalesce("_status", F.lit("dangling")).alias("status"))
        now, seen = materialize_observed(now.where("status != 'open'").unionByName(moving), "report", still)
        settled, left, reach = seen["left"] == left, seen["left"], 2 * reach
    on_cycle = now.where("status = 'open'").select(F.col("entity_id").alias("ptr"), F.col("least").alias("cycle"))
    known = now.join(on_cycle, "ptr", "left")
    done = known.select("entity_id", F.when(F.col("status") == "ok", F.col("ptr")).alias("root_id"), F.when(F.col("status") == "open", "cycle").otherwise(F.col("status")).alias("status"),
        F.when(F.col("status") == "open", F.col("cycle")).when(F.col("status") == "dangling", F.col("ptr")).alias("witness"))
    return done


def root_closure(entities: DataFrame) -> DataFrame:
    """``(entity_id, root_id)`` by pointer jumping: every round doubles how far each pointer reaches, so a chain of
    depth n takes log2(n) joins. Roots map to themselves; chains that end at a missing parent or in a cycle have no row."""
    still = F.count(F.when(~F.col("done"), 1)).alias("left")
    first = entities.select("entity_id", F.coalesce("parent_id", "entity_id").alias("ptr"), F.col("parent_id").isNull().alias("done"))
    now, seen = materialize_observed(first, "roots", still)
    left = seen["left"]
    while left:
        ahead = now.select(F.col("entity_id").alias("_id"), F.col("ptr").alias("_ptr"), F.col("done").alias("_done"))
        moving = now.where("not done").join(ahead, F.col("ptr") == F.col("_id")).select("entity_id", F.col("_ptr").alias("ptr"), F.col("_done").alias("done"))
        now, seen = materialize_observed(now.where("done").unionByName(moving), "roots", still)
        if seen["left"] == left:
            break
        left = seen["left"]
    return now.where("done").select("entity_id", F.col("ptr").alias("root_id"))


def _restricted(kids: DataFrame, units: DataFrame | None) -> DataFrame:
    return kids if units is None else kids.join(units.select("parent_id").distinct(), "parent_id", "left_semi")


def internal_deps(deps: DataFrame, entities: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """``(commit_key, parent_id, src_id, tgt_id, kind)`` between two different children of one parent; repeats stay."""
    kids = _restricted(entities.where("parent_id is not null").select("parent_id", "entity_id"), units)
    own = deps.where("src_id != tgt_id").select(commit_key().alias("commit_key"), "src_id", "tgt_id", "kind")
    if units is not None and "commit_key" in units.columns:
        own = own.join(units.select("commit_key").distinct(), "commit_key", "left_semi")
    tgt = kids.select(F.col("entity_id").alias("tgt_id"), "parent_id")
    src = kids.select(F.col("entity_id").alias("src_id"), "parent_id")
    return own.join(tgt, "tgt_id").join(src, ["src_id", "parent_id"]).select("commit_key", "parent_id", "src_id", "tgt_id", "kind")


def outside_deps(deps: DataFrame, entities: DataFrame, roots: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """``(commit_key, parent_id, root_id, tgt_id, kind)``: dependencies on a unit's children from another root, the
    source lifted to its root. A parent without a root has none."""
    kids = _restricted(entities.where("parent_id is not null").select("parent_id", F.col("entity_id").alias("tgt_id")), units)
    own_root = roots.select(F.col("entity_id").alias("parent_id"), F.col("root_id").alias("own_root"))
    src = roots.select(F.col("entity_id").alias("src_id"), "root_id")
    own = deps.select(commit_key().alias("commit_key"), "src_id", "tgt_id", "kind")
    return own.join(kids.join(own_root, "parent_id"), "tgt_id").join(src, "src_id").where("root_id != own_root").select("commit_key", "parent_id", "root_id", "tgt_id", "kind")


def clients(outside: DataFrame, entities: DataFrame) -> DataFrame:
    """``(commit_key, parent_id, entity_id, name, kind)``: the distinct roots that depend on a unit."""
    pairs = outside.select("commit_key", "parent_id", F.col("root_id").alias("entity_id")).distinct()
    return pairs.join(entities.select("entity_id", "name", "kind"), "entity_id").select("commit_key", "parent_id", "entity_id", "name", "kind")


def client_deps(outside: DataFrame) -> DataFrame:
    """Distinct ``(commit_key, parent_id, src_id, tgt_id, kind)`` with the client root as source."""
    return outside.select("commit_key", "parent_id", F.col("root_id").alias("src_id"), "tgt_id", "kind").distinct()


def label_clients(units: DataFrame, entities: DataFrame, found: DataFrame) -> DataFrame:
    """``(commit_key, parent_id, entity_id, name, start_byte, is_client)``: each unit's children, then its clients with
    their names marked."""
    kids = units.select("commit_key", "parent_id").join(entities.select("parent_id", "entity_id", "name", "start_byte"), "parent_id").withColumn("is_client", F.lit(False))
    more = units.select("commit_key", "parent_id").join(found, ["commit_key", "parent_id"]).select(
        "commit_key", "parent_id", "entity_id", F.concat(F.lit(CLIENT), "name").alias("name"), F.lit(None).cast("long").alias("start_byte"), F.lit(True).alias("is_client")
    )
    return kids.select(more.columns).unionByName(more)
