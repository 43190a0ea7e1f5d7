"""Streaming queries (J1, J2, J4): each stages its input as file drops in
the shared checkpoint folder, runs the stream to completion (availableNow)
and returns the sink table, whose rows must equal the batch operator's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.rollout import MAX_STEPS
from ..sources.fixtures import fixture
from ..streaming import episodes as ST
from ..streaming.membership import IdIndex
from ..streaming.runner import (
    new_area, read_published, run_append, run_complete, run_indexed_intake, stage_drops, stream_session,
)
from .q_reports import _BUCKET_SQL
from .registry import query

_RAW_STEPS = ["episode", "event_id", "ts", "action", "exit_code", "stdout"]
FILES_PER_DROP = 4  # files (writer tasks) per staged drop at least; a micro-batch reads the files of one drop


IDLE_MS = 6 * 3_600_000


def _steps_in_drops(spark, sf_dir, area, last_beat: str):
    """The step log staged as three late drops, and heartbeats past its end."""
    raw = fixture(spark, sf_dir, "steps").select(*_RAW_STEPS).withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.when(F.col("event_id") % 2 == 0, F.expr("interval 30 minutes")).otherwise(F.expr("interval 0 minutes"))
    files = stage_drops(raw.withColumn("_arrives", F.col("ts") + late), f"{area}/in", "_arrives", 3, key="episode",
                        files_per_drop=FILES_PER_DROP)
    # a heartbeat past the last step moves the watermark over it
    last = spark.read.parquet(f"{area}/in_src").agg(F.max("ts").alias("ts"))
    last.select(F.lit(None).cast("bigint").alias("episode"), F.lit(-1).cast("bigint").alias("event_id"),
                (F.col("ts") + F.expr(last_beat)).alias("ts"), F.lit(ST.HEARTBEAT).alias("action"),
                F.lit(0).alias("exit_code"), F.lit("").alias("stdout")) \
        .coalesce(1).write.mode("append").parquet(f"{area}/in")
    return raw.schema, files


@query("q_stream_episodes", ops="J2, E7, D13", views=("steps",), oracle=f"""
, term as (
  select episode, least(coalesce(min(case when action = 'submit' then step end), {MAX_STEPS}), {MAX_STEPS}) as end_step,
    max(step) as last_step, min(case when action = 'submit' then step end) as fs
  from steps group by episode),
done as (select * from term where fs is not null or last_step >= {MAX_STEPS})
select d.episode, cast(d.end_step as bigint) as steps,
  cast(count(*) filter (where s.step < d.end_step and s.exit_code <> 0) as bigint) as nonzero_exits,
  cast(coalesce(sum(case when s.step < d.end_step then length(s.stdout) end), 0) as bigint) as total_output_chars,
  cast(case when d.end_step <= 1 then 1.0 else 0.0 end as double) as immediate_submit,
  case when d.fs is not null and d.fs <= {MAX_STEPS} then 'submit' else 'forced' end as end_reason
from done d join steps s on s.episode = d.episode
group by d.episode, d.end_step, d.fs
""")
def q_stream_episodes(spark, sf_dir):
    area = new_area(spark, "episodes")
    schema, files = _steps_in_drops(spark, sf_dir, area, "interval 2 hours")
    ss = stream_session(spark)
    stream = (ss.readStream.schema(schema).option("maxFilesPerTrigger", files)
              .parquet(f"{area}/in"))
    run_append(ST.episode_stream(stream), f"{area}/out", f"{area}/ckpt")
    return spark.read.parquet(f"{area}/out")


@query("q_stream_idle", ops="J3, J2, E7", views=("steps",), oracle=f"""
, g as (
  select *, lead(ts) over w > ts + interval {IDLE_MS // 3_600_000} hours or lead(ts) over w is null as pause
  from steps window w as (partition by episode order by step)),
e as (
  select episode, min(case when action = 'submit' or pause or step = {MAX_STEPS} then step end) as end_step from g group by episode),
x as (
  select g.*, e.end_step,
    case when l.action = 'submit' then 'submit' when e.end_step = {MAX_STEPS} then 'forced' else 'timeout' end as end_reason
  from g join e on e.episode = g.episode join g l on l.episode = g.episode and l.step = e.end_step)
select episode, cast(end_step as bigint) as steps,
  cast(count(*) filter (where exit_code <> 0 and (step < end_step or step = end_step and end_reason = 'timeout')) as bigint) as nonzero_exits,
  cast(coalesce(sum(case when step < end_step or step = end_step and end_reason = 'timeout' then length(stdout) end), 0) as bigint)
    as total_output_chars,
  cast(case when end_step <= 1 then 1.0 else 0.0 end as double) as immediate_submit, end_reason
from x group by episode, end_step, end_reason
""")
def q_stream_idle(spark, sf_dir):
    """Episodes that end by a submit, by the step cap or by six idle hours,
    whichever comes first in event time."""
    area = new_area(spark, "idle")
    schema, files = _steps_in_drops(spark, sf_dir, area, "interval 9 hours")
    ss = stream_session(spark)
    stream = ss.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{area}/in")
    run_append(ST.episode_stream(stream, idle_ms=IDLE_MS), f"{area}/out", f"{area}/ckpt")
    return spark.read.parquet(f"{area}/out")


@query("q_stream_report", ops="J4, D6", views=("instance_results",), oracle=f"""
select count(*) as total_instances,
  cast(count(*) filter (where b = 'passed') as bigint) as resolved_instances,
  cast(count(*) filter (where b <> 'passed') as bigint) as unresolved_instances,
  cast(count(*) filter (where b = 'error') as bigint) as error_instances,
  cast(count(*) filter (where b = 'empty') as bigint) as empty_patch_instances,
  case when count(*) > 0 then cast(count(*) filter (where b = 'passed') as double) / count(*) else 0.0 end as resolve_rate
from (select {_BUCKET_SQL} as b from instance_results) t
""")
def q_stream_report(spark, sf_dir):
    area = new_area(spark, "report")
    res = fixture(spark, sf_dir, "instance_results").withColumn(
        "k", F.substring("instance_id", 7, 1 << 20).try_cast("bigint"))
    files = stage_drops(res, f"{area}/in", "k", 3, key="instance_id", files_per_drop=FILES_PER_DROP)
    ss = stream_session(spark)
    stream = (ss.readStream.schema(res.schema).option("maxFilesPerTrigger", files)
              .parquet(f"{area}/in"))
    run_complete(ST.running_report(stream), f"{area}/out", f"{area}/ckpt")
    return read_published(spark, f"{area}/out")


@query("q_stream_intake", ops="J1, C1, G12", views=("logs", "instance_results"), oracle="""
select distinct l.instance_id, 'agent-model' as model_name_or_path
from logs l
where l.instance_id not in (select instance_id from instance_results where error is null)
""")
def q_stream_intake(spark, sf_dir):
    area = new_area(spark, "intake")
    logs = fixture(spark, sf_dir, "logs")
    # one prediction per job log, keyed by the instance it was written for
    p = T.log_predictions("logs", F.col("instance_id"), F.lit("agent-model"))
    preds = logs.select("instance_id", F.substring("instance_id", 7, 1 << 20).try_cast("bigint").alias("k"),
                        p["model_name_or_path"].alias("model_name_or_path"))
    files = stage_drops(preds, f"{area}/in", "k", 3, fmt="json", key="instance_id", files_per_drop=FILES_PER_DROP)
    # a writer that re-sends some predictions: duplicates across drops
    stage_drops(preds.filter(F.col("k") % 5 == 0), f"{area}/in", "k", 1, fmt="json", key="instance_id",
                files_per_drop=FILES_PER_DROP)
    ss = stream_session(spark)

    completed = IdIndex(ss, f"{area}/completed")
    completed.add(fixture(ss, sf_dir, "instance_results").filter(F.col("error").isNull()).select("instance_id"), -1)
    stream = (ss.readStream.schema("instance_id string, k long, model_name_or_path string")
              .option("maxFilesPerTrigger", files).json(f"{area}/in"))
    run_indexed_intake(stream.select("instance_id", "model_name_or_path"), completed, IdIndex(ss, f"{area}/taken"),
                       f"{area}/out", f"{area}/ckpt")
    return spark.read.parquet(f"{area}/out").select("instance_id", "model_name_or_path")
