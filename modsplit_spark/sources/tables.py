"""Readers that bring entity and dependency tables to the library's schema, and the sinks."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORKDIR = "WORKDIR"


def entities_from(raw: DataFrame) -> DataFrame:
    """``entity_id, parent_id, name, kind, start_byte`` from a table with binary id and parent_id."""
    return raw.select(F.lower(F.hex("id")).alias("entity_id"), F.lower(F.hex("parent_id")).alias("parent_id"), "name", "kind", F.col("start_byte").cast("long").alias("start_byte"))


def deps_from(raw: DataFrame) -> DataFrame:
    """``src_id, tgt_id, kind, commit_id`` from a table with binary src and tgt; an empty commit becomes null."""
    return raw.select(F.lower(F.hex("src")).alias("src_id"), F.lower(F.hex("tgt")).alias("tgt_id"), "kind", F.nullif(F.col("commit_id").cast("string"), F.lit("")).alias("commit_id"))


def commit_key(commit_id: str | Column = "commit_id") -> Column:
    """The commit's name: null and empty are the working directory."""
    return F.coalesce(F.nullif(F.col(commit_id) if isinstance(commit_id, str) else commit_id, F.lit("")), F.lit(WORKDIR))


def assignment_lines(assignments: DataFrame) -> DataFrame:
    """``(commit_key, parent_id, ix, line)``: each node's name and its path as a list."""
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), ", ")
    return assignments.select("commit_key", "parent_id", "ix", F.format_string("%s : [%s]", F.col("name"), path).alias("line"))


def write_assignments(assignments: DataFrame, path: str) -> None:
    """All units' lines as one Parquet table in order of unit and node, each unit in few files; fails if ``path`` exists."""
    lines = assignment_lines(assignments).repartitionByRange("commit_key", "parent_id", "ix").sortWithinPartitions("commit_key", "parent_id", "ix")
    lines.write.mode("errorifexists").parquet(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """All units' JSON documents (column ``json``) as one Parquet table in order of unit; fails if ``path`` exists."""
    kept = documents.select("commit_key", "parent_id", "json").repartitionByRange("commit_key", "parent_id").sortWithinPartitions("commit_key", "parent_id")
    kept.write.mode("errorifexists").parquet(path)


def export_unit(table: DataFrame, commit: str, parent_id: str, path: str) -> None:
    """One unit of a written table as text: its lines in order, or its document. For the few units that someone reads; fails if ``path`` exists."""
    unit = table.where((F.col("commit_key") == commit) & (F.col("parent_id") == parent_id))
    text = unit.select("json") if "json" in table.columns else unit.orderBy("ix").select("line")
    text.coalesce(1).write.mode("errorifexists").text(path)


# ---------------------------------------------------------------- reading a store of entities and dependencies

#: Columns a store's tables must have.
ENTITY_COLUMNS = {"id": "binary", "parent_id": "binary", "name": "string", "kind": "string", "start_byte": "integral"}
DEP_COLUMNS = {"src": "binary", "tgt": "binary", "kind": "string", "commit_id": "any"}


def _checked(raw: DataFrame, columns: dict[str, str], table: str) -> DataFrame:
    """``raw``'s columns of that name; ValueError if one is missing or of another type. Text is taken for binary by its bytes."""
    kinds = dict(raw.dtypes)
    fits = {"binary": ("binary", "string"), "string": ("string",), "integral": ("tinyint", "smallint", "int", "bigint")}
    wrong = [f"{c} ({kinds.get(c, 'missing')}, not {kind})" for c, kind in columns.items() if c not in kinds or kind != "any" and kinds[c] not in fits[kind]]
    if wrong:
        raise ValueError(f"{table}: {', '.join(wrong)}")
    return raw.select(*(F.col(c).cast("binary") if kind == "binary" else F.col(c) for c, kind in columns.items()))


def read_store(spark: SparkSession, table: str, path: str | None = None, jdbc: Mapping[str, str] | None = None, bounds: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table of a store: the Parquet folder ``path``/``table``.parquet, or a table behind ``jdbc`` (url, driver, ...).

    ``bounds`` (column, least, most, partitions) splits a JDBC table into as many ranges of a numeric column, each read by a
    task of its own; filters on the frame are pushed to either source."""
    if (path is None) == (jdbc is None):
        raise ValueError("one of path and jdbc")
    if path is not None:
        return spark.read.parquet(f"{path}/{table}.parquet")
    reader = spark.read.format("jdbc").options(**jdbc).option("dbtable", table).option("pushDownPredicate", "true")
    if bounds is not None:
        column, least, most, partitions = bounds
        reader = reader.option("partitionColumn", column).option("lowerBound", least).option("upperBound", most).option("numPartitions", partitions)
    return reader.load()


def read_entities(raw: DataFrame, kinds: Collection[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``entities_from`` of a store's rows, and the rows it rejects, ``(entity_id, parent_id, name, kind, start_byte, reason)``.

    Rejected are rows with a null id (``null_id``), all but one row of an id (``repeated_id``; the one of least parent, start, name and
    kind stays, nulls first), and rows of a kind not among ``kinds``, if some are given (``unknown_kind``). Wrong columns raise ValueError."""
    rows = entities_from(_checked(raw, ENTITY_COLUMNS, "entities"))
    known = F.lit(True) if kinds is None else F.coalesce(F.col("kind").isin(list(kinds)), F.lit(False))
    reason = F.when(F.col("entity_id").isNull(), "null_id").when(~known, "unknown_kind")
    judged = rows.withColumn("reason", reason)
    fit = judged.where("reason is null").drop("reason")
    # Copies meet in an aggregation, one row a task of each, not in a window over an id.
    record = F.struct("parent_id", "start_byte", "name", "kind")
    one = fit.groupBy("entity_id").agg(F.min(record).alias("r"), F.count("*").alias("n"))
    good = one.select("entity_id", "r.parent_id", "r.name", "r.kind", "r.start_byte")
    again = fit.join(one.where("n > 1").select("entity_id", "r"), "entity_id").withColumn("same", F.struct("parent_id", "start_byte", "name", "kind").eqNullSafe(F.col("r")))
    copies = again.groupBy("entity_id", "parent_id", "name", "kind", "start_byte", "same").count()
    left = copies.withColumn("count", F.col("count") - F.when(F.col("same"), 1).otherwise(0)).where("count > 0").withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("count").cast("int"))))
    columns = ["entity_id", "parent_id", "name", "kind", "start_byte"]
    rejected = judged.where("reason is not null").select(*columns, "reason").unionByName(left.select(*columns, F.lit("repeated_id").alias("reason")))
    return good, rejected


def read_deps(raw: DataFrame, commit_id: str | None = ..., kinds: Collection[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``deps_from`` of a store's rows, and the rejected ones with ``reason``: ``null_end`` or ``unknown_kind``. Repeated rows stay.

    With a ``commit_id`` (None and '' are the working directory) the source itself filters by it. Wrong columns raise ValueError."""
    checked = _checked(raw, DEP_COLUMNS, "deps")
    if commit_id is not ...:
        checked = checked.where(F.col("commit_id") == commit_id if commit_id else F.col("commit_id").isNull() | (F.col("commit_id") == ""))
    rows = deps_from(checked)
    known = F.lit(True) if kinds is None else F.coalesce(F.col("kind").isin(list(kinds)), F.lit(False))
    reason = F.when(F.col("src_id").isNull() | F.col("tgt_id").isNull(), "null_end").when(~known, "unknown_kind")
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


# ---------------------------------------------------------------- sinks by commit


def write_by_commit(frame: DataFrame, path: str, *order: str) -> None:
    """``frame`` as Parquet in a folder a commit, each in order of unit and ``order``. Commits that ``frame`` holds are replaced, the files of all
    others stay as they are. Of a written table ``export_unit`` reads one commit's folder, and there the row groups whose range holds the unit."""
    keys = ["commit_key", "parent_id", *order]
    dealt = frame.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt.write.partitionBy("commit_key").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_fragments(fragments: DataFrame, path: str) -> None:
    """Documents in fragments (unit, key, text), by commit and in order; ``export_fragments`` joins those of one unit."""
    write_by_commit(fragments, path, "key")


def export_fragments(table: DataFrame, commit: str, parent_id: str, path: str) -> None:
    """One unit's fragments of a written table as text files, in order from the first file's first line to the last; fails if ``path`` exists."""
    unit = table.where((F.col("commit_key") == commit) & (F.col("parent_id") == parent_id))
    unit.orderBy("key").select("text").write.mode("errorifexists").text(path)
