"""The tracking sink (A12), prediction stores (A4) and what is read from
them."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from rewardlake.operators import reports as R
from rewardlake.sources import store as ST
from rewardlake.sources import tracking as TR
from rewardlake.sources.shared import filesystem
from rewardlake.streaming.runner import new_area, run_append


def _rows(spark, *rows):
    return spark.createDataFrame([(r, "metric", k, v, None) for r, k, v in rows], TR.ROWS)


def _now(spark, root):
    return sorted((r.run_id, r.key, r.num_value) for r in TR.read_runs(spark, root).collect())


def _data(root):
    return sorted(os.listdir(f"{root}/_data")) if os.path.isdir(f"{root}/_data") else []


def test_a_run_written_again_replaces_its_rows(spark, tmp_dir):
    TR.write_runs(_rows(spark, ("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)).repartition(3), tmp_dir)
    TR.write_runs(_rows(spark, ("a", "x", 9.0)), tmp_dir)
    assert _now(spark, tmp_dir) == [("a", "x", 9.0), ("b", "x", 3.0)]
    TR.write_runs(_rows(spark), tmp_dir)                          # nothing written changes nothing
    assert _now(spark, tmp_dir) == [("a", "x", 9.0), ("b", "x", 3.0)]
    TR.write_runs(_rows(spark, ("c", "x", 1.0)), tmp_dir, "overwrite")
    assert _now(spark, tmp_dir) == [("c", "x", 1.0)]


def test_a_failed_write_leaves_nothing_and_is_recorded(spark, tmp_dir):
    assert TR.track(_rows(spark, ("a", "x", 1.0)), tmp_dir)
    before = _data(tmp_dir)
    for bad in ([("a", "x", 5.0), (None, "x", 1.0)], [("a", None, 1.0)]):
        rows = _rows(spark, *([("a", f"k{i}", 0.0) for i in range(50)] + bad))
        assert TR.track(rows.repartition(4), tmp_dir) is False
    kind = _rows(spark, ("a", "x", 1.0)).withColumn("kind", F.lit("tag"))
    assert TR.track(kind, tmp_dir) is False
    late = _rows(spark, ("a", "x", 1.0)).withColumn("num_value", F.raise_error(F.lit("gone")).cast("double"))
    assert TR.track(late, tmp_dir) is False                       # the plan fails, not the sink
    assert _now(spark, tmp_dir) == [("a", "x", 1.0)] and _data(tmp_dir) == before
    got = TR.failures(spark, tmp_dir).collect()
    assert len(got) == 4 and any("has no run_id" in r.message for r in got) and any("gone" in r.message for r in got)


def test_a_store_that_cannot_be_written_does_not_end_the_job(spark, tmp_dir):
    path = f"{tmp_dir}/file"
    open(path, "w").close()                                       # a file where the store's folder should be
    assert TR.track(_rows(spark, ("a", "x", 1.0)), path) is False


def test_uncommitted_files_are_not_read(spark, tmp_dir):
    TR.write_runs(_rows(spark, ("a", "x", 1.0)), tmp_dir)
    writer = TR.TrackingWriter(tmp_dir, False)
    message = writer.write(iter(_rows(spark, ("a", "x", 7.0)).toArrow().to_batches()))
    assert message.rows == 1 and _now(spark, tmp_dir) == [("a", "x", 1.0)]      # written, not committed
    writer.abort([message, None])
    assert len(_data(tmp_dir)) == 1
    writer.abort([])                                              # again: nothing to do
    writer = TR.TrackingWriter(tmp_dir, False)
    message = writer.write(iter(_rows(spark, ("a", "x", 7.0)).toArrow().to_batches()))
    writer.commit([message, None])
    assert _now(spark, tmp_dir) == [("a", "x", 7.0)]


def test_compact_keeps_the_present_rows(spark, tmp_dir):
    for v in range(4):
        TR.write_runs(_rows(spark, ("a", "x", float(v)), (f"r{v}", "y", 0.0)), tmp_dir)
    before = _now(spark, tmp_dir)
    TR.compact(spark, tmp_dir)
    assert _now(spark, tmp_dir) == before and len(_data(tmp_dir)) == 1 and len(os.listdir(f"{tmp_dir}/_commits")) == 1
    TR.write_runs(_rows(spark, ("a", "x", 5.0)), tmp_dir)
    assert ("a", "x", 5.0) in _now(spark, tmp_dir) and len(_now(spark, tmp_dir)) == 5


def test_an_empty_store_is_empty(spark, tmp_dir):
    assert TR.read_runs(spark, f"{tmp_dir}/none").collect() == [] and TR.failures(spark, f"{tmp_dir}/none").collect() == []


def test_params_follow_the_strategy(spark):
    configs = spark.createDataFrame(
        [("n", "naive", 1, 100, 0.5, 9, "mean"), ("a", "agent", 1, 100, None, 9, "mean"), ("m", "agent", 3, 100, 0.5, 9, "mean")],
        "run_id string, strategy string, max_turns int, max_tokens int, temperature double, step_limit int, aggregator string")
    got: dict = {}
    for r in R.tracked_params(configs).collect():
        got.setdefault(r.run_id, {})[r.key] = r.value
    assert got == {"n": {"strategy": "naive", "run_id": "n", "max_turns": "1", "max_tokens": "100", "temperature": "0.5"},
                   "a": {"strategy": "agent", "run_id": "a", "max_turns": "1", "step_limit": "9"},
                   "m": {"strategy": "agent", "run_id": "m", "max_turns": "3", "step_limit": "9", "aggregator": "mean"}}
    results = spark.createDataFrame([("a", None, True, True), ("a", "boom", False, None), ("m", None, True, False), ("x", None, True, True)],
                                    "run_id string, error string, patch_exists boolean, resolved boolean")
    rows = R.tracked_runs(results, configs.withColumn("run_eval", F.lit(False))).filter("kind = 'metric'").collect()
    metrics = {}
    for r in rows:
        metrics.setdefault(r.run_id, {})[r.key] = r.num_value
    assert metrics["a"] == {"total_instances": 2.0, "patches_generated": 1.0, "generation_errors": 1.0}
    assert metrics["n"] == {"total_instances": 0.0, "patches_generated": 0.0, "generation_errors": 0.0}
    assert metrics["m"] == {"total_instances": 1.0, "patches_generated": 1.0, "generation_errors": 0.0, "evaluated": 1.0,
                            "completion_rate": 1.0, "resolved": 0.0, "resolve_rate": 0.0} and "x" not in metrics


# ------------------------------------------------------------- prediction store
def _put(root, folder, content, file=ST.FILE, at=None):
    os.makedirs(f"{root}/{folder}", exist_ok=True)
    path = f"{root}/{folder}/{file}"
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else json.dumps(content).encode())
    if at is not None:
        os.utime(path, (at, at))


def test_store_reads_what_can_be_read(spark, tmp_dir):
    good = {"instance_id": "a", "model_patch": "+x\né", "model_name_or_path": "m"}
    _put(tmp_dir, "a", good)
    _put(tmp_dir, "other-name", good | {"instance_id": "b", "model_patch": None})
    _put(tmp_dir, "numbers", {"instance_id": 7, "model_patch": ["x"]})
    for name, content in {"broken": b'{"instance_id"', "list": ["a"], "no-id": {"model_patch": ""}, "null-id": {"instance_id": None},
                          "bytes": b"\xff\xfe\x00", "empty": b""}.items():
        _put(tmp_dir, name, content)
    _put(tmp_dir, "elsewhere", good, file="report.json")
    _put(tmp_dir, "deep/deeper", good)
    os.makedirs(f"{tmp_dir}/folder/{ST.FILE}")                     # a folder of that name
    with open(f"{tmp_dir}/{ST.FILE}", "w") as f:                  # not in a folder
        json.dump(good | {"instance_id": "top"}, f)
    _put(tmp_dir, "secret", good)
    os.chmod(f"{tmp_dir}/secret/{ST.FILE}", 0)
    got = sorted((r.instance_id, r.model_patch, r.model_name_or_path) for r in ST.read_store(spark, tmp_dir).collect())
    want = [("7", '["x"]', None), ("a", "+x\né", "m"), ("b", None, "m")]
    if os.access(f"{tmp_dir}/secret/{ST.FILE}", os.R_OK):          # root reads everything
        want.insert(1, ("a", "+x\né", "m"))
    assert got == sorted(want, key=str) or got == sorted(want)
    assert ST.read_store(spark, f"{tmp_dir}/none").collect() == []


def test_listing_is_split_by_prefix_and_dealt_over_tasks(spark, tmp_dir):
    for i in range(60):
        _put(tmp_dir, f"{'ab'[i % 2]}{i}", {"instance_id": f"{i}", "model_patch": "", "model_name_or_path": "m"})
    listing = ST.list_store(spark, f"file://{tmp_dir}", ("a", "b"))
    assert listing.rdd.getNumPartitions() == 2 and listing.count() == 60
    assert listing.filter("size < 10 or modified_ms < 1600000000000").count() == 0
    some = ST.read_store(spark, tmp_dir, ("a",), files=7)
    assert some.count() == 30 and some.rdd.getNumPartitions() >= 5
    assert ST.read_store(spark, tmp_dir, ("a", "b")).select("instance_id").distinct().count() == 60


def test_stream_reads_only_what_is_new(spark, tmp_dir):
    area = new_area(spark, "t-store")
    record = {"instance_id": "a", "model_patch": "p", "model_name_or_path": "m"}
    base = 1_700_000_000
    _put(tmp_dir, "a", record, at=base)
    _put(tmp_dir, "b", record | {"instance_id": "b"}, at=base + 5)

    def run():
        run_append(ST.stream_store(spark, tmp_dir, settle_ms=1), f"{area}/out", f"{area}/ckpt")
        return sorted(r.instance_id for r in spark.read.parquet(f"{area}/out").collect())
    assert run() == ["a", "b"]
    assert run() == ["a", "b"]
    _put(tmp_dir, "c", record | {"instance_id": "c"})
    _put(tmp_dir, "late", record | {"instance_id": "late"}, at=base + 9)     # older than what was read: not new
    import time
    time.sleep(0.05)
    assert run() == ["a", "b", "c"]
    reader = ST._StoreStream({"path": tmp_dir, "settle_ms": "0"})
    first = reader.latestOffset()
    assert reader.initialOffset() == {"until_ms": -1} and reader.latestOffset()["until_ms"] >= first["until_ms"]
    parts = reader.partitions({"until_ms": base * 1000}, {"until_ms": (base + 5) * 1000})
    assert [r["instance_id"] for b in reader.read(parts[0]) for r in b.to_pylist()] == ["b"]


def test_paths_of_the_shared_store():
    for path in ("/tmp/x", "file:/tmp/x", "file:///tmp/x", "file:///tmp/x/"):
        assert filesystem(path)[1] == "/tmp/x"
