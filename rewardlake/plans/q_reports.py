"""Report queries: D5-D9, B6, A8, A12."""

from __future__ import annotations


from ..functions import text as T
from ..operators import reports as R
from ..sources.fixtures import fixture
from . import duck as D
from .registry import query

_BUCKET_SQL = """
case when error is not null then 'error'
     when not coalesce(patch_exists, false) then 'empty'
     when coalesce(resolved, false) then 'passed'
     else 'failed' end
"""


@query("q_resolve_report", ops="D6 (flagship)", views=("instance_results",), oracle=f"""
select count(*) as total_instances,
  cast(count(*) filter (where b = 'passed') as bigint) as resolved_instances,
  cast(count(*) filter (where b <> 'passed') as bigint) as unresolved_instances,
  cast(count(*) filter (where b = 'error') as bigint) as error_instances,
  cast(count(*) filter (where b = 'empty') as bigint) as empty_patch_instances,
  case when count(*) > 0 then cast(count(*) filter (where b = 'passed') as double) / count(*) else 0.0 end as resolve_rate
from (select {_BUCKET_SQL} as b from instance_results) t
""")
def q_resolve_report(spark, sf_dir):
    return R.resolve_report(fixture(spark, sf_dir, "instance_results"))


@query("q_resolve_ids", ops="D6 id lists", views=("instance_results",), oracle=f"""
select l.list_name, instance_id
from (select instance_id, {_BUCKET_SQL} as b from instance_results) t
join (values ('error', 'error_ids'), ('error', 'unresolved_ids'), ('passed', 'resolved_ids'),
             ('empty', 'unresolved_ids'), ('failed', 'unresolved_ids')) as l(b, list_name) on l.b = t.b
""")
def q_resolve_ids(spark, sf_dir):
    return R.report_ids(fixture(spark, sf_dir, "instance_results"))


@query("q_report", ops="D5", views=("instance_results",), oracle=f"""
select count(*) as total,
  cast(count(*) filter (where b = 'passed') as bigint) as passed,
  cast(count(*) filter (where b <> 'passed') as bigint) as failed,
  cast(count(*) filter (where b = 'error') as bigint) as errors,
  cast(count(*) filter (where b = 'empty') as bigint) as empty,
  case when count(*) > 0 then cast(count(*) filter (where b = 'passed') as double) / count(*) else 0.0 end as pass_rate
from (select {_BUCKET_SQL} as b from instance_results) t
""")
def q_report(spark, sf_dir):
    return R.base_report(fixture(spark, sf_dir, "instance_results"))


_FLAGS_SQL = """
select instance_id, coalesce(error <> '', false) as is_error,
  (not coalesce(error <> '', false)) and resolved is not null as evaluated,
  (not coalesce(error <> '', false)) and resolved is not null and resolved = true as is_resolved
from instance_results
"""


@query("q_eval_flags", ops="B6", views=("instance_results",), oracle=_FLAGS_SQL)
def q_eval_flags(spark, sf_dir):
    return R.eval_flags(fixture(spark, sf_dir, "instance_results"))


@query("q_run_results", ops="D7", views=("instance_results",), oracle=f"""
select count(*) as total_instances,
  cast(count(*) filter (where evaluated) as bigint) as evaluated,
  case when count(*) > 0 then cast(count(*) filter (where evaluated) as double) / count(*) else 0.0 end as completion_rate,
  cast(count(*) filter (where is_resolved) as bigint) as resolved_instances,
  cast(count(*) filter (where evaluated and not is_resolved) as bigint) as unresolved_instances,
  cast(count(*) filter (where is_error) as bigint) as error_instances,
  case when count(*) filter (where evaluated) > 0
       then cast(count(*) filter (where is_resolved) as double) / count(*) filter (where evaluated) else 0.0 end as resolve_rate
from ({_FLAGS_SQL}) f
""")
def q_run_results(spark, sf_dir):
    return R.run_results(fixture(spark, sf_dir, "instance_results"))


@query("q_run_result_ids", ops="D7 id lists", views=("instance_results",), oracle=f"""
select 'error_ids' as list_name, instance_id from ({_FLAGS_SQL}) f where is_error
union all
select 'resolved_ids', instance_id from ({_FLAGS_SQL}) f where is_resolved
""")
def q_run_result_ids(spark, sf_dir):
    return R.run_result_ids(fixture(spark, sf_dir, "instance_results"))


_METRICS_SQL = f"""
with f as ({_FLAGS_SQL.replace('from instance_results', ', coalesce(patch_exists, false) as has_patch from instance_results')}),
w as (
  select cast(count(*) as double) as total_instances,
    cast(count(*) filter (where has_patch) as double) as patches_generated,
    cast(count(*) filter (where is_error) as double) as generation_errors,
    cast(count(*) filter (where evaluated) as double) as evaluated,
    cast(count(*) filter (where is_resolved) as double) as resolved
  from f)
select 'total_instances' as key, total_instances as value from w
union all select 'patches_generated', patches_generated from w
union all select 'generation_errors', generation_errors from w
union all select 'evaluated', evaluated from w
union all select 'completion_rate', case when total_instances > 0 then evaluated / total_instances else 0.0 end from w
union all select 'resolved', resolved from w
union all select 'resolve_rate', case when evaluated > 0 then resolved / evaluated else 0.0 end from w
"""


@query("q_metrics_map", ops="D9", views=("instance_results",), oracle=f"select * from ({_METRICS_SQL}) m")
def q_metrics_map(spark, sf_dir):
    return R.run_metrics(fixture(spark, sf_dir, "instance_results"))


TRACKED_PARAMS = {"strategy": "agent", "dataset": "lite", "split": "test",
                  "max_turns": "3", "aggregator": "mean"}


@query("q_metrics_long", ops="A12, D9", views=("instance_results",), oracle=f"""
select 'run-1' as run_id, 'metric' as kind, key, value as num_value, cast(null as varchar) as str_value
from ({_METRICS_SQL}) m
union all
select 'run-1', 'param', k, cast(null as double), v from (values
  ('strategy', 'agent'), ('dataset', 'lite'), ('split', 'test'),
  ('max_turns', '3'), ('aggregator', 'mean')) as p(k, v)
""")
def q_metrics_long(spark, sf_dir):
    return R.tracking_rows(fixture(spark, sf_dir, "instance_results"), "run-1", TRACKED_PARAMS)


_TRAJ = D.between("l.logs", T.TRAJ_START, T.TRAJ_END)


@query("q_artifact_plan", ops="A8", views=("instance_results", "logs"), oracle=f"""
select instance_id, 'prediction.json' as artifact, 'prediction' as content from instance_results
union all
select instance_id, 'report.json', case when resolved is not null then 'eval_report' else 'error' end
from instance_results
union all
select l.instance_id, 'pod_logs.txt', 'logs' from logs l
where l.logs is not null and l.logs <> ''
  and l.instance_id in (select instance_id from instance_results)
union all
select l.instance_id, l.instance_id || '.traj.json', 'trajectory' from logs l
where {_TRAJ} <> '' and l.instance_id in (select instance_id from instance_results)
""")
def q_artifact_plan(spark, sf_dir):
    return R.artifact_plan(fixture(spark, sf_dir, "instance_results"), fixture(spark, sf_dir, "logs"))
