"""The id index (J1) against a set, and how much it opens."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from rewardlake.streaming.membership import IdIndex, _words
from rewardlake.streaming.runner import (
    current_version, new_area, publish, read_published, run_indexed_intake,
)


def _ids(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "instance_id string")


def _seen(index, spark, ids, epoch):
    return sorted(r.id for r in index.seen(_ids(spark, ids), epoch).collect())


def test_index_matches_a_set(spark, tmp_dir):
    rnd = random.Random(1)
    index, held = IdIndex(spark, tmp_dir, buckets=4), set()
    assert _seen(index, spark, ["a", None], 0) == []
    for epoch in range(5):
        batch = {f"id-{rnd.randrange(900)}" for _ in range(120)}
        assert _seen(index, spark, [*batch, *list(batch)[:9], None], epoch) == sorted(batch & held)
        index.add(_ids(spark, batch - held), epoch)
        held |= batch
    again = IdIndex(spark, tmp_dir, buckets=99)                   # the number of buckets is the index's own
    assert again.buckets == 4 and _seen(again, spark, ["id-1", "x", *sorted(held)[:50]], 9) == sorted({*sorted(held)[:50]} | ({"id-1"} & held))


def test_an_epoch_added_again_replaces_itself(spark, tmp_dir):
    index = IdIndex(spark, tmp_dir, buckets=2)
    index.add(_ids(spark, ["a", "b"]), -1)
    index.add(_ids(spark, ["c", "d"]), 0)
    assert _seen(index, spark, ["a", "c", "e"], 0) == ["a"]       # the epoch itself sees what was before it
    index.add(_ids(spark, ["c", "d"]), 0)
    assert _seen(index, spark, ["a", "b", "c", "d", "e"], 1) == ["a", "b", "c", "d"]
    index.add(_ids(spark, []), 1)
    assert _seen(index, spark, ["d"], 2) == ["d"]


def test_unfinished_epochs_are_not_seen(spark, tmp_dir):
    index = IdIndex(spark, tmp_dir, buckets=2)
    index.add(_ids(spark, ["a"]), 0)
    heads = sorted(os.listdir(f"{tmp_dir}/heads"))
    index.add(_ids(spark, ["b"]), 1)
    os.remove(f"{tmp_dir}/heads/{sorted(os.listdir(f'{tmp_dir}/heads'))[-1]}")  # as if the epoch had failed before its heads
    assert sorted(os.listdir(f"{tmp_dir}/heads")) == heads and _seen(index, spark, ["a", "b"], 1) == ["a"]


def test_only_buckets_that_may_hold_an_id_are_opened(spark, tmp_dir):
    index = IdIndex(spark, tmp_dir, buckets=64)
    index.add(spark.range(20_000).select(F.concat(F.lit("old-"), "id").alias("instance_id")), 0)
    assert _seen(index, spark, [f"new-{i}" for i in range(40)], 1) == []
    assert index.looked <= 40 and index.opened <= 6               # false hits of the filters
    assert _seen(index, spark, ["old-5", *[f"new-{i}" for i in range(40)]], 1) == ["old-5"]
    assert 1 <= index.opened <= 7
    # what a question reads does not grow with the number of epochs
    index.add(spark.range(20_000).select(F.concat(F.lit("older-"), "id").alias("instance_id")), 1)
    _seen(index, spark, ["new-1"], 2)
    assert index.looked == 1


def test_filters_grow_with_their_buckets():
    assert [_words(n) for n in (0, 1, 4, 5, 16, 17, 10_000)] == [1, 1, 1, 4, 4, 16, 4096]


def test_intake_takes_ids_once_and_never_completed_ones(spark):
    area = new_area(spark, "t-indexed")
    schema = "instance_id string, model_name_or_path string"
    for rows in ([("a", "m"), ("b", "m"), ("a", "k"), (None, "m")], [("b", "m"), ("c", "m"), ("z", "m")], [("a", "n"), ("d", "m")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{area}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{area}/in")
    done, taken = IdIndex(spark, f"{area}/done", 8), IdIndex(spark, f"{area}/taken", 8)
    done.add(_ids(spark, ["c", "y"]), -1)
    run_indexed_intake(stream, done, taken, f"{area}/out", f"{area}/ckpt")
    got = sorted((r.instance_id, r.model_name_or_path) for r in spark.read.parquet(f"{area}/out").collect())
    assert got == [("a", "k"), ("b", "m"), ("d", "m"), ("z", "m")]


# -- published snapshots (J4) -------------------------------------------------
def test_readers_find_a_whole_version(spark, tmp_dir):
    out = f"{tmp_dir}/report"
    with pytest.raises(FileNotFoundError):
        read_published(spark, out)
    publish(spark.range(3), out, 0)
    held = read_published(spark, out)
    publish(spark.range(5), out, 1)
    assert held.count() == 3 and read_published(spark, out).count() == 5     # an earlier reader still has its version
    broken = spark.range(4).select(F.raise_error(F.lit("lost")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish(broken, out, 2)
    assert current_version(out) == 1 and read_published(spark, out).count() == 5
    publish(spark.range(7), out, 2)
    publish(spark.range(1), out, 1)                                # an epoch run again: not newer
    assert current_version(out) == 2 and read_published(spark, out).count() == 7
    for v in range(3, 8):
        publish(spark.range(v), out, v)
    assert sorted(n for n in os.listdir(out) if n.startswith("v=")) == ["v=5", "v=6", "v=7"]
