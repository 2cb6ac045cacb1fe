"""Bounded, repeatable samples of labelled rows for fitting a classifier, and the folds held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def sample_ids(rows: DataFrame, label: str, per_label: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``per_label`` ids of each label value, those with the least hash: ``(doc_id, label)``, each pair once.

    Labels are counted first, so that only about that many ids of each label reach the ranking."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.select(doc_id, label).limit(0)
    place = F.pmod(F.xxhash64(doc_id, F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(1.3 * per_label / n + 20 / n))])
    likely = rows.select(doc_id, label, place.alias("_place")).where(F.col("_place") < share[F.col(label)]).distinct()
    rank = F.row_number().over(W.partitionBy(label).orderBy("_place", doc_id))
    return likely.withColumn("_rank", rank).where(F.col("_rank") <= per_label).select(doc_id, label)
