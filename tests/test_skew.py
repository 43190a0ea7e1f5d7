"""A key holding a third of all rows: the chunked scan spreads it over
tasks; a plain per-key window would put it into one partition."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rewardlake.operators.sequence import running_sum


def _hot(spark, n=30_000):
    # key 0 holds a third of the rows, over many days; 200 cold keys share the rest
    return (spark.range(n)
            .select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 200 + 1).alias("k"),
                    F.col("id").alias("t"),
                    F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts")))


def _max_share(df):
    # ``n`` is referenced so the window is not pruned away
    rows = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("n").alias("c")).collect()
    counts = [r["c"] for r in rows]
    return max(counts) / sum(counts)


def test_hot_key_is_spread_by_chunks(spark):
    # small test data: keep AQE from coalescing the shuffle into one partition
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _check(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _check(spark):
    df = _hot(spark)
    plain = df.withColumn("n", F.sum(F.lit(1)).over(
        Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    chunked = running_sum(df, ["k"], ["t"], F.to_date("ts"), F.lit(1), "n")
    assert _max_share(plain) >= 1 / 3
    assert _max_share(chunked) < 0.25
    # and the numbering is the same
    a = {(r.k, r.t): r.n for r in plain.select("k", "t", "n").collect()}
    b = {(r.k, r.t): r.n for r in chunked.select("k", "t", "n").collect()}
    assert a == b


def test_join_back_is_split_by_aqe(spark):
    from rewardlake.operators.rollout import group_advantage
    rows = _hot(spark, 300_000).select(F.col("k").alias("prompt_id"), F.col("t").alias("sample"),
                                       (F.col("t") % 7).cast("double").alias("reward"), F.sha2(F.col("t").cast("string"), 512).alias("text"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        share = group_advantage(rows).groupBy(F.spark_partition_id().alias("p")) \
                                     .agg(F.count("advantage").alias("c"), F.max("text").alias("t"))
        counts = [r["c"] for r in share.collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(counts) == 300_000 and max(counts) < 0.25 * 300_000, counts


def test_null_keys_are_groups_in_joins_back(spark):
    from rewardlake.operators.rollout import group_advantage
    df = spark.createDataFrame([(None, 0, 1.0), (None, 1, 0.0), (1, 0, 1.0)], "prompt_id long, sample int, reward double")
    got = {(r.prompt_id, r.sample): round(r.advantage, 3) for r in group_advantage(df).collect()}
    assert got == {(None, 0): 0.707, (None, 1): -0.707, (1, 0): 0.0}
