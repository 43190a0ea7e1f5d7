"""Sink round trips (A7, A9, A11): data derived from the tables is written
with the library's writers to the shared checkpoint folder and read back, so
the oracle checks what the sink actually stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import images as IM
from ..operators import joins as J
from ..operators import reports as R
from ..sources import files as FS
from ..sources import tracking as TR
from ..sources.fixtures import fixture
from ..sources.tables import table
from ..streaming.runner import new_area
from . import duck as D
from .q_reports import _BUCKET_SQL
from .registry import query


@query("q_sink_jsonl", ops="A7, C2", views=("tasks", "logs"), oracle=f"""
select t.pos, t.instance_id, coalesce(p.model_patch, '') as model_patch,
  coalesce(p.model_name_or_path, 'unknown') as model_name_or_path
from tasks t join (
  select instance_id, {D.between('logs', T.PATCH_START, T.PATCH_END)} as model_patch, 'agent-model' as model_name_or_path
  from logs where strpos(logs, {D.lit(T.APPLY_FAILED)}) = 0) p on p.instance_id = t.instance_id
""")
def q_sink_jsonl(spark, sf_dir):
    lg = fixture(spark, sf_dir, "logs")
    stored = (lg.filter(T.apply_status("logs") != "failed")
              .select("instance_id", T.log_patch("logs").alias("model_patch"),
                      F.lit("agent-model").alias("model_name_or_path")))
    merged = J.merge_predictions(fixture(spark, sf_dir, "tasks"), stored)
    path = new_area(spark, "sink-jsonl")
    FS.write_jsonl(merged, path, order="pos")
    return spark.read.schema("pos long, instance_id string, model_patch string, model_name_or_path string").json(path)


@query("q_sink_summary", ops="A9, D6", views=("instance_results",), oracle=f"""
select count(*) as total_instances,
  cast(count(*) filter (where b = 'passed') as bigint) as resolved_instances,
  cast(count(*) filter (where b <> 'passed') as bigint) as unresolved_instances,
  cast(count(*) filter (where b = 'error') as bigint) as error_instances,
  cast(count(*) filter (where b = 'empty') as bigint) as empty_patch_instances,
  case when count(*) > 0 then cast(count(*) filter (where b = 'passed') as double) / count(*) else 0.0 end as resolve_rate
from (select {_BUCKET_SQL} as b from instance_results) t
""")
def q_sink_summary(spark, sf_dir):
    report = R.resolve_report(fixture(spark, sf_dir, "instance_results"))
    path = new_area(spark, "sink-summary")
    FS.write_summary(report, path)
    return spark.read.schema(report.schema).json(path)


@query("q_sink_text_list", ops="A11, D14", views=("images",), oracle="""
select distinct image from images where image is not null
""")
def q_sink_text_list(spark, sf_dir):
    path = new_area(spark, "sink-list")
    FS.write_text_list(IM.unique_images(fixture(spark, sf_dir, "images")), "image", path)
    return spark.read.text(path).select(F.col("value").alias("image"))


def _run_results(cond: str = "true", shift: int = 0) -> str:
    """SQL of the results of six runs, and with ``shift`` of later tries."""
    return f"""
select concat('run-', cast((o_orderkey + {shift}) % 6 as string)) as run_id, o_orderkey as k,
  case when o_orderkey % 13 = 0 then 'job_failed' else null end as error, o_orderkey % 10 <> 0 as patch_exists,
  case when o_orderkey % 19 = 0 then null else o_orderstatus = 'F' end as resolved
from orders where {cond}"""


_CONFIGS = [("run-0", "naive", "m1", "1", False), ("run-1", "agent", "m1", "1", True), ("run-2", "agent", "m2", "1", False),
            ("run-3", "naive", "m2", "3", False), ("run-4", "agent", None, "3", True), ("run-5", "agent", "m3", "2", True)]
_CONFIG_TYPE = ("run_id string, strategy string, model_name string, max_turns string, run_eval boolean, max_tokens string, "
                "temperature string, step_limit string, aggregator string")


def _configs(spark, *runs):
    rows = [(*c, "4096", "0.5", "100", "mean") for c in _CONFIGS if not runs or c[0] in runs]
    return spark.createDataFrame(rows, _CONFIG_TYPE)


_TRACK_SQL = f"""
with r as ({_run_results("o_orderkey % 6 not in (1, 4)").replace("as string", "as varchar")}
  union all {_run_results("o_orderkey % 4 = 0 and (o_orderkey + 3) % 6 in (1, 4)", 3).replace("as string", "as varchar")}),
c(run_id, strategy, model_name, max_turns, run_eval) as (values {", ".join(
    f"('{i}', '{s}', {'null' if m is None else repr(m)}, {t}, {str(e).lower()})" for i, s, m, t, e in _CONFIGS)}),
g as (
  select c.*, max_turns > 1 or strategy = 'agent' and run_eval as judges, cast(count(r.run_id) as double) as total,
    cast(count(*) filter (where r.run_id is not null and patch_exists) as double) as patches,
    cast(count(*) filter (where coalesce(error, '') <> '') as double) as errors,
    cast(count(*) filter (where r.run_id is not null and coalesce(error, '') = '' and resolved is not null) as double) as evaluated,
    cast(count(*) filter (where coalesce(error, '') = '' and resolved) as double) as resolved_n
  from c left join r on r.run_id = c.run_id group by all),
m as (
  select run_id, judges, unnest(['total_instances', 'patches_generated', 'generation_errors', 'evaluated', 'completion_rate',
      'resolved', 'resolve_rate']) as key,
    unnest([total, patches, errors, evaluated, case when total > 0 then evaluated / total else 0 end, resolved_n,
      case when evaluated > 0 then resolved_n / evaluated else 0 end]) as num_value from g),
p as (
  select run_id, unnest(['strategy', 'model_name', 'run_id', 'max_turns', 'max_tokens', 'temperature', 'step_limit', 'aggregator']) as key,
    unnest([strategy, model_name, run_id, cast(max_turns as varchar), case when strategy = 'naive' then '4096' end,
      case when strategy = 'naive' then '0.5' end, case when strategy <> 'naive' then '100' end,
      case when max_turns > 1 then 'mean' end]) as str_value from c)
"""


@query("q_track_runs", ops="A12, D9", oracle=f"""
{_TRACK_SQL}
select run_id, 'metric' as kind, key, num_value, cast(null as varchar) as str_value from m
where judges or key in ('total_instances', 'patches_generated', 'generation_errors')
union all
select run_id, 'param', key, null, str_value from p where str_value is not null
union all
select 'store', 'failure', 'recorded', 1, null
""")
def q_track_runs(spark, sf_dir):
    """Six runs are tracked; two of them again, which replaces their rows; a
    third write meets a row without a run, leaves nothing and is recorded."""
    root = new_area(spark, "tracking")
    orders = table(spark, sf_dir, "orders")
    sql = lambda cond, shift=0: spark.sql(_run_results(cond, shift).replace("from orders", "from {orders}"), orders=orders)
    done = [TR.track(R.tracked_runs(sql("true"), _configs(spark)), root),
            TR.track(R.tracked_runs(sql("o_orderkey % 4 = 0", 3), _configs(spark, "run-1", "run-4")), root)]
    bad = R.tracked_runs(sql("o_orderkey % 5 = 0"), _configs(spark, "run-2", "run-5"))
    # the last row of a run's metrics has lost its run
    lost = F.when((F.col("key") == "resolve_rate"), F.lit(None)).otherwise(F.col("run_id"))
    done.append(TR.track(bad.withColumn("run_id", lost), root))
    told = TR.failures(spark, root).agg(F.count(F.lit(1)).cast("double").alias("num_value"))
    if done != [True, True, False]:
        raise RuntimeError(f"tracking gave {done}")
    return TR.read_runs(spark, root).unionByName(told.select(
        F.lit("store").alias("run_id"), F.lit("failure").alias("kind"), F.lit("recorded").alias("key"), "num_value",
        F.lit(None).cast("string").alias("str_value")))
