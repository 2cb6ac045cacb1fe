"""Relational algebra on hierarchical clusterings: frames ``(clustering_id, entity, path array<string>)``, always sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modsplit_spark.functions import paths as P
from modsplit_spark.functions.paths import SEPARATOR
from modsplit_spark.operators.ranks import numbered

ID = "clustering_id"
#: Members of a block of an inverted index.
BLOCK = 10_000
COLUMNS = [ID, "entity", "path"]


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(COLUMNS).unionByName(b.select(COLUMNS)).distinct()


def subset(clustering: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows of the listed entities (column ``entity``)."""
    return clustering.join(entities.select("entity").distinct(), "entity", "left_semi").select(COLUMNS)


def truncate(clustering: DataFrame, level: int) -> DataFrame:
    return clustering.select(ID, "entity", P.path_truncate(F.col("path"), level).alias("path")).distinct()


def expand(clustering: DataFrame) -> DataFrame:
    """Every entity with all prefixes of its paths."""
    return clustering.select(ID, "entity", F.explode(P.path_ancestors(F.col("path"), with_self=True)).alias("path")).distinct()


def contract(clustering: DataFrame) -> DataFrame:
    """Each entity keeps only clusters that are no ancestor of another of its clusters. In path order a descendant follows
    its ancestor directly, so one look ahead decides."""
    after = F.lead("path").over(W.partitionBy(ID, "entity").orderBy("path"))
    return clustering.withColumn("_next", after).where(~F.coalesce(P.is_ancestor_of(F.col("path"), F.col("_next")), F.lit(False))).select(COLUMNS)


def without_singletons(clustering: DataFrame) -> DataFrame:
    """Clusters of more than one entity, at the deepest level left to each entity."""
    wide = expand(clustering)
    large = wide.groupBy(ID, "path").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return contract(wide.join(large, [ID, "path"], "left_semi").select(COLUMNS))


def num_levels(clustering: DataFrame) -> DataFrame:
    """``(clustering_id, num_levels)``: the longest path."""
    return clustering.groupBy(ID).agg(F.max(F.size("path")).alias("num_levels"))


def fill(clustering: DataFrame, placeholder: str) -> DataFrame:
    """All paths padded to the clustering's depth."""
    joined = clustering.join(num_levels(clustering), ID)
    return joined.select(ID, "entity", P.path_fill(F.col("path"), placeholder, F.col("num_levels")).alias("path")).distinct()


def per_level(clustering: DataFrame) -> DataFrame:
    """``(clustering_id, level, entity, path)``: the truncations to every level; short paths stand unchanged at each."""
    levels = num_levels(clustering).where("num_levels > 0").select(ID, F.explode(F.sequence(F.lit(0), F.col("num_levels") - 1)).alias("level"))
    return clustering.join(levels, ID).select(ID, "level", "entity", P.path_truncate(F.col("path"), F.col("level")).alias("path")).distinct()


def root(clustering: DataFrame) -> DataFrame:
    """``(clustering_id, root)``: the longest common prefix of all paths, which is that of the least and the greatest."""
    ends = clustering.groupBy(ID).agg(F.min("path").alias("a"), F.max("path").alias("b"))
    differ = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), False)
    shorter = F.least(F.size("a"), F.size("b"))
    return ends.select(ID, F.slice("a", 1, F.when(differ > 0, (differ - 1).cast("int")).otherwise(shorter)).alias("root"))


def without_root(clustering: DataFrame) -> DataFrame:
    joined = clustering.join(root(clustering), ID)
    return joined.select(ID, "entity", F.slice("path", F.size("root") + 1, F.greatest(F.size("path"), F.lit(1))).alias("path")).distinct()


def with_root(clustering: DataFrame, segments: list[str]) -> DataFrame:
    if any(P.SEPARATOR in s for s in segments):
        raise ValueError("a path segment contains $")
    return clustering.select(ID, "entity", F.concat(F.array(*map(F.lit, segments)).cast("array<string>"), "path").alias("path")).distinct()


def replace_root(clustering: DataFrame, segments: list[str]) -> DataFrame:
    return with_root(without_root(clustering), segments)


def with_isolated(clustering: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds listed ``(clustering_id, entity)`` that have no row as clusters of their own."""
    alone = entities.select(ID, "entity").distinct().join(clustering.select(ID, "entity"), [ID, "entity"], "left_anti")
    return clustering.select(COLUMNS).unionByName(alone.withColumn("path", F.array("entity")))


def normalize(clustering: DataFrame) -> DataFrame:
    return with_isolated(without_singletons(without_root(clustering)), entities(clustering))


def entities(clustering: DataFrame) -> DataFrame:
    return clustering.select(ID, "entity").distinct()


def clusters(clustering: DataFrame) -> DataFrame:
    return clustering.select(ID, "path").distinct()


def singleton_clusters(clustering: DataFrame) -> DataFrame:
    """``(clustering_id, path, entity)`` of clusters with one entity."""
    return clustering.groupBy(ID, "path").agg(F.count("*").alias("_n"), F.min("entity").alias("entity")).where("_n = 1").drop("_n")


def singleton_entities(clustering: DataFrame) -> DataFrame:
    """``(clustering_id, entity, path)`` of entities with one cluster."""
    return clustering.groupBy(ID, "entity").agg(F.count("*").alias("_n"), F.min("path").alias("path")).where("_n = 1").drop("_n")


def entities_for(clustering: DataFrame) -> DataFrame:
    """``(clustering_id, path, entities)``."""
    return clustering.groupBy(ID, "path").agg(F.sort_array(F.collect_set("entity")).alias("entities"))


def clusters_for(clustering: DataFrame) -> DataFrame:
    """``(clustering_id, entity, paths)``."""
    return clustering.groupBy(ID, "entity").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def _blocks(clustering: DataFrame, key: str, member: str, size: int) -> DataFrame:
    pairs = clustering.select(ID, F.col(key).alias("key"), F.col(member).alias("member")).distinct()
    keyed = pairs.withColumn("_key", F.col("key") if key == "entity" else F.array_join("key", SEPARATOR))
    placed = numbered(keyed, [ID, "_key"], ["member"], "_place").withColumn("block", F.floor(F.col("_place") / size).cast("int"))
    return placed.groupBy(ID, "_key", "block").agg(F.first("key").alias(key), F.sort_array(F.collect_list("member")).alias("members")).select(ID, key, "block", "members")


def entities_blocks(clustering: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(clustering_id, path, block, members)``: as ``entities_for``, in blocks of at most ``size`` sorted entities; one after another
    they are a cluster's entities, so a cluster that holds all of them is many rows."""
    return _blocks(clustering, "path", "entity", size)


def clusters_blocks(clustering: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(clustering_id, entity, block, members)``: as ``clusters_for``, in blocks of at most ``size`` sorted paths."""
    return _blocks(clustering, "entity", "path", size)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks in order of their key, so that a lookup of one key reads the few files whose range holds it; fails if ``path`` exists."""
    key = "path" if "path" in blocks.columns else "entity"
    keyed = blocks.withColumn("key", F.array_join("path", SEPARATOR) if key == "path" else F.col(key))
    keyed.repartitionByRange(ID, "key", "block").sortWithinPartitions(ID, "key", "block").write.mode("errorifexists").parquet(path)


def look_up(spark: SparkSession, path: str, clustering_id: str, key: str) -> DataFrame:
    """The members of one key, from its blocks alone."""
    found = spark.read.parquet(path).where((F.col(ID) == clustering_id) & (F.col("key") == key))
    return found.select("block", F.explode("members").alias("member"))
