"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only where driver and executors are one machine may it be unset: then a new local folder is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-work-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Unlike a cached table it survives lost executors, and later stages start from the files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/table-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_observed(df: DataFrame, tag: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """As ``materialize``, with aggregates of the rows taken while they are written."""
    seen = Observation()
    return materialize(df.observe(seen, *metrics), tag), seen.get
