"""Session helpers: cluster sizing and the checkpoint folder rule."""

from __future__ import annotations

from rewardlake.session import cluster_conf, ensure_checkpoint_dir


def test_cluster_conf_sizes_partitions():
    big = cluster_conf(100 << 40, executor_cores=8, executors=1000)
    assert big["spark.sql.shuffle.partitions"] == "100000"          # capped
    small = cluster_conf(10 << 30, executor_cores=4, executors=10)
    assert small["spark.sql.shuffle.partitions"] == "120"             # 3 waves of 40 cores
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert int(big["spark.sql.files.maxPartitionBytes"]) == 256 << 20


def test_checkpoint_dir_is_read_from_the_session(spark):
    current = spark.conf.get("spark.checkpoint.dir")
    assert ensure_checkpoint_dir(spark) == current                    # never replaced once set


def test_small_side_broadcasts_only_within_bound(spark):
    from rewardlake.operators.joins import small_side
    df = spark.range(11)
    assert small_side(df, max_rows=10) is df                         # over the bound: left to the planner
    hinted = small_side(df, max_rows=100)
    assert hinted is not df
    assert "broadcast" in hinted._jdf.queryExecution().analyzed().toString().lower()


def test_stream_session_uses_core_count(spark):
    from rewardlake.streaming.runner import stream_session
    s = stream_session(spark)
    assert s.conf.get("spark.sql.shuffle.partitions") == str(spark.sparkContext.defaultParallelism)
    assert spark.conf.get("spark.sql.shuffle.partitions") != "" and s is not spark
