"""Streaming operators: stream/batch equality for the episode reducer over
drops that split episodes, and the idle timeout (J3)."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as E
from rewardlake.operators import rollout as RO
from rewardlake.sources.fixtures import fixture
from rewardlake.streaming import episodes as ST
from rewardlake.streaming.runner import late_rows_dropped, new_area, run_append, run_intake, stage_drops, stream_session
from tests.conftest import SF_SMALL


def test_stream_equals_batch_summary(spark):
    stream = {r.episode: r for r in E.queries()["q_stream_episodes"](spark, SF_SMALL).collect()}
    steps = fixture(spark, SF_SMALL, "steps")
    empty_patch = spark.createDataFrame([], "episode long, patch string")
    no_grade = spark.createDataFrame([], "episode long, resolved boolean")
    batch = {r.episode: r for r in RO.episode_summary(steps, empty_patch, no_grade).collect()}
    assert stream.keys() == batch.keys()
    for k, s in stream.items():
        b = batch[k]
        assert (s.steps, s.nonzero_exits, s.total_output_chars, s.immediate_submit) == \
            (b.steps, b.nonzero_exits, b.total_output_chars, b.immediate_submit)


STEP = "episode long, event_id long, t long, action string, exit_code int, stdout string"


def _run(spark, name, drops, **settings):
    """Run the drops as one micro-batch each; the summaries in order of emission, and the progress."""
    area = new_area(spark, name)
    for rows in drops:
        (spark.createDataFrame(rows, STEP).withColumn("ts", F.timestamp_seconds("t")).drop("t")
         .coalesce(1).write.mode("append").parquet(f"{area}/in"))
    sch = spark.read.parquet(f"{area}/in").schema
    stream = stream_session(spark).readStream.schema(sch).option("maxFilesPerTrigger", 1).parquet(f"{area}/in")
    progress = run_append(ST.episode_stream(stream, **settings), f"{area}/out", f"{area}/ckpt")
    out = [(r.episode, r.steps, r.nonzero_exits, r.total_output_chars, r.end_reason)
           for r in spark.read.parquet(f"{area}/out").collect()]
    return sorted(out), progress


def _beat(t):
    return [(None, -t, t, ST.HEARTBEAT, 0, "")]


def _reducer_rows(progress):
    return next(op["numRowsTotal"] for op in progress[-1]["stateOperators"] if "transformWithState" in op["operatorName"])


def test_drops_hold_rows_without_an_order_value(spark):
    d = spark.range(60).select("id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"))
    for name, rows, least in (("some", d, 4), ("all", d.withColumn("k", F.lit(None).cast("bigint")), 4), ("none", d.where("id < 0"), 4)):
        area = new_area(spark, name)
        assert stage_drops(rows, f"{area}/in", "k", 3, key="id") == least
        assert spark.read.schema(rows.schema).parquet(f"{area}/in").count() == rows.count()
    area = new_area(spark, "sized")
    assert stage_drops(d, f"{area}/in", "k", 3, key="id", file_bytes=200) > 4


def test_a_step_without_time_counts_as_the_first(spark):
    base = 1_700_000_000
    out, _ = _run(spark, "null-ts", [[(1, 2, None, "run", 1, "abc"), (1, 1, base, "run", 0, "x")],
                                     [(1, 3, base + 60, "submit", 0, "")], _beat(base + 9000), _beat(base + 9001)])
    assert out == [(1, 3, 1, 4, "submit")]


def test_forced_submit_and_idle_timeout(spark):
    base = 1_700_000_000
    rows = [(1, i, base + i, "bash", 0, "x") for i in range(1, 106)]   # never submits -> forced at the cap
    rows.append((2, 1000, base + 1, "bash", 1, "yy"))                  # goes idle
    got, _ = _run(spark, "t-idle", [rows, _beat(base + 10_000), _beat(base + 10_001)],
                  max_steps=100, watermark="10 minutes", idle_ms=60_000)
    assert got == [(1, 100, 0, 99, "forced"), (2, 1, 1, 2, "timeout")]


def test_a_closed_episode_does_not_start_again(spark):
    base = 1_700_000_000
    drops = [[(1, 1, base, "bash", 1, "a")], _beat(base + 5_000), _beat(base + 5_001),      # closed as idle
             [(1, 2, base + 6_000, "bash", 0, "b"), (1, 3, base + 6_001, "submit", 0, "")],  # comes back
             _beat(base + 20_000), _beat(base + 20_001)]
    got, _ = _run(spark, "t-back", drops, watermark="10 minutes", idle_ms=60_000)
    assert got == [(1, 1, 1, 1, "timeout")]


def test_the_end_of_an_episode_follows_event_time_only(spark):
    """A pause ends an episode whether the steps after it come in the same
    micro-batch, later or out of order."""
    base = 1_700_000_000
    steps = [(1, 1, base, "bash", 1, "a"), (1, 2, base + 100, "bash", 1, "bb"), (1, 3, base + 500, "bash", 0, "c"),
             (1, 4, base + 510, "submit", 0, "")]
    beats = [_beat(base + 9_000), _beat(base + 9_001)]
    for name, drops in {"one": [steps], "each": [[s] for s in steps], "odd": [steps[2:], steps[:1], steps[1:2]]}.items():
        got, _ = _run(spark, f"t-order-{name}", [*drops, *beats], watermark="1 hour", idle_ms=200_000)
        assert got == [(1, 2, 2, 3, "timeout")], name


def test_episode_end_cases():
    def steps(*at, submit=()):
        return [(t * 1000, i, 1, 0, i in submit) for i, t in enumerate(at)]
    end = ST.episode_end
    assert end([], 10, 5, 3) is None
    assert end(steps(1, 2, submit=(1,)), 1, 5, None) is None       # the submit is not final yet
    assert end(steps(1, 2, submit=(1,)), 2, 5, None)[1] == "submit"
    assert end(steps(1, 2, 3), 3, 3, None)[1] == "forced" and end(steps(1, 2, 3), 3, 4, None) is None
    assert end(steps(1, 2), 5, 9, 3)[1] == "timeout" and end(steps(1, 2), 4, 9, 3) is None
    assert len(end(steps(1, 2, 6), 6, 9, 3)[0]) == 2               # a pause before the last step
    assert end(steps(1, 2, 5), 6, 9, 3) is None                    # a pause of just the limit is none
    assert end([(1500, 0, 1, 0, True)], 1, 5, None) is None and end([(1500, 0, 1, 0, True)], 2, 5, None)[1] == "submit"


def test_long_running_episodes_keep_bounded_state(spark):
    drops = [[(1, 1000 * d + i, 100 * d + i, "bash", 0, "x") for i in range(50)] for d in range(1, 7)]
    got, progress = _run(spark, "t-bound", [*drops, _beat(90_000), _beat(90_001)], max_steps=20, watermark="1 hour")
    assert got == [(1, 20, 0, 19, "forced")]
    assert max(op["numRowsTotal"] for p in progress for op in p["stateOperators"] if "transformWithState" in op["operatorName"]) < 100


def test_steps_out_of_order_within_the_watermark_count(spark):
    drops = [[(1, 10, 100, "bash", 0, "a"), (1, 11, 200, "bash", 0, "bb"), (1, 12, 300, "bash", 0, "c"),
              (2, 20, 100, "bash", 1, "x")],                                # episode 2 never submits
             [(1, 14, 400, "submit", 0, ""), (1, 15, 450, "bash", 1, "after")],
             [(1, 13, 250, "bash", 1, "late")],                             # before step 3, after the submit was seen
             _beat(9_000), _beat(9_001)]
    got, progress = _run(spark, "t-late", drops, watermark="1 hour")
    assert got == [(1, 5, 1, 8, "submit")]
    assert late_rows_dropped(progress) == 0


def test_state_of_closed_episodes_is_removed(spark):
    drops = [[(e, e, 100 + e, "submit", 0, "") for e in range(1, 6)], _beat(10_000), _beat(10_001),
             _beat(200_000), _beat(200_001), _beat(200_002)]
    got, progress = _run(spark, "t-state", drops, watermark="10 minutes", closed_ms=3_600_000)
    assert [g[:2] for g in got] == [(e, 1) for e in range(1, 6)]
    assert _reducer_rows(progress) == 0


def test_rows_behind_watermark_are_dropped_and_counted(spark):
    drops = [[(1, 1, 10_000, "bash", 0, "a"), (2, 2, 20_000, "bash", 0, "b")],
             # late rows are judged against the watermark of the previous micro-batch
             # (as Spark does for chained stateful operators), hence the filler drop
             [(1, 5, 20_050, "bash", 0, "c")],
             [(3, 3, 20_000 - 7_200, "submit", 0, "")],        # two hours behind the newest event
             [(2, 4, 20_100, "submit", 0, "")], _beat(30_000), _beat(30_001)]
    got, progress = _run(spark, "t-wm", drops, watermark="1 hour")
    assert [g[:2] for g in got] == [(2, 2)]          # episode 3's only step came too late
    assert late_rows_dropped(progress) == 1


def test_intake_takes_an_id_once_however_late_it_comes_again(spark):
    area = new_area(spark, "t-intake")
    schema = "instance_id string, model_name_or_path string"
    for rows in ([("a", "m"), ("b", "m"), ("a", "m")], [("b", "m"), ("c", "m")], [("a", "n"), ("d", "m")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{area}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{area}/in")
    done = spark.createDataFrame([("c",)], "instance_id string")
    run_intake(stream, lambda: done, f"{area}/out", f"{area}/ckpt")
    got = [(r.instance_id, r.model_name_or_path) for r in spark.read.parquet(f"{area}/out").collect()]
    assert sorted(got) == [("a", "m"), ("b", "m"), ("d", "m")]
