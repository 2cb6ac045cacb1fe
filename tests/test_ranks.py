import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modsplit_spark.operators.ranks import running


@pytest.mark.parametrize(("groups", "rows"), [(1, 3000), (3, 3000), (700, 2000), (5, 4)])
def test_as_a_window_over_the_group(spark, groups, rows):
    """Also where one group spans many partitions, and with a null group."""
    rnd = random.Random(rows)
    data = [(None if (g := min(rnd.randrange(groups), rnd.randrange(groups))) == 1 else g, i, rnd.randrange(-50, 50), "t" * (i % 9)) for i in range(rows)]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "g long, o long, v long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = running(df, ["g"], ["o"], "n", {"total": F.col("v")}, {"h": F.xxhash64("v"), "k": F.xxhash64(F.lit(3), "v")})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    w = W.partitionBy("g").orderBy("o")
    want = df.withColumn("n", F.row_number().over(w).cast("long")).withColumn("total", F.sum("v").over(w))
    assert sorted(map(repr, got.drop("h", "k").collect())) == sorted(map(repr, want.collect()))
    # Equal prefixes, and only they, have equal hashes.
    lists = df.withColumn("p", F.collect_list("v").over(w)).select(F.col("o").alias("o2"), F.array_join("p", ",").alias("p"))
    seen = got.join(lists, F.col("o") == F.col("o2")).agg(F.count_distinct("p"), F.count_distinct("h"), F.count_distinct("k"), F.count_distinct("p", "h", "k")).first()
    assert len(set(seen)) == 1


def test_no_rows_and_no_key(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "o long")
    assert sorted(tuple(r) for r in running(df, [], ["o"], "n", {"s": F.col("o")}).collect()) == [(1, 1, 1), (2, 2, 3), (3, 3, 6)]
    assert running(df.limit(0), ["o"], ["o"], "n").collect() == []
