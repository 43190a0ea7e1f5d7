"""Verifier scoring queries: B3-B5, B13, C5, C7, D1-D3, D18, F2, G18, G21."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import feedback as FB
from ..operators import scoring as S
from ..sources.fixtures import fixture
from ..sources.tables import table
from .registry import query

_EFF = "case when status = 'ok' then score else cast(0.0 as double) end"
_INSTANCES = "(select doc_id as instance_id from documents)"


def _instances(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("instance_id"))


def _vr(spark, sf_dir):
    return fixture(spark, sf_dir, "verifier_results")


def _cfg(spark, sf_dir):
    return fixture(spark, sf_dir, "verifier_config")


@query("q_passed", ops="B5", views=("verifier_results",), oracle="""
select instance_id, name, coalesce(status = 'ok' and score >= pass_threshold, false) as passed
from verifier_results
""")
def q_passed(spark, sf_dir):
    return S.with_passed(_vr(spark, sf_dir)).select("instance_id", "name", "passed")


@query("q_agg_mean", ops="D1", views=("verifier_results",), oracle=f"""
select i.instance_id, coalesce(a.s, cast(1.0 as double)) as score
from {_INSTANCES} i left join
  (select instance_id, avg({_EFF}) as s from verifier_results group by instance_id) a
  on a.instance_id = i.instance_id
""")
def q_agg_mean(spark, sf_dir):
    return S.aggregate_scores(_instances(spark, sf_dir), _vr(spark, sf_dir), "mean")


@query("q_agg_min", ops="D2", views=("verifier_results",), oracle=f"""
select i.instance_id, coalesce(a.s, cast(1.0 as double)) as score
from {_INSTANCES} i left join
  (select instance_id, min({_EFF}) as s from verifier_results group by instance_id) a
  on a.instance_id = i.instance_id
""")
def q_agg_min(spark, sf_dir):
    return S.aggregate_scores(_instances(spark, sf_dir), _vr(spark, sf_dir), "min")


@query("q_agg_weighted", ops="D3, C7", views=("verifier_results", "verifier_config"), oracle=f"""
select i.instance_id, coalesce(a.s, cast(1.0 as double)) as score
from {_INSTANCES} i left join
  (select r.instance_id,
     case when sum(coalesce(c.weight, 1.0)) = 0 then cast(1.0 as double)
          else sum(({_EFF.replace('status', 'r.status').replace('score', 'r.score')}) * coalesce(c.weight, 1.0))
               / sum(coalesce(c.weight, 1.0)) end as s
   from verifier_results r left join verifier_config c on c.name = r.name
   group by r.instance_id) a
  on a.instance_id = i.instance_id
""")
def q_agg_weighted(spark, sf_dir):
    return S.aggregate_scores(_instances(spark, sf_dir), _vr(spark, sf_dir), "weighted_sum",
                              weights=_cfg(spark, sf_dir))


@query("q_all_passed", ops="D18, B3", views=("verifier_results", "verifier_config"), oracle="""
select i.instance_id, coalesce(a.ap, true) as all_passed
from (select doc_id as instance_id from documents) i left join
  (select r.instance_id, bool_and(coalesce(r.status = 'ok' and r.score >= r.pass_threshold, false)) as ap
   from verifier_results r join verifier_config c on c.name = r.name and c.run_intermediate
   group by r.instance_id) a
  on a.instance_id = i.instance_id
""")
def q_all_passed(spark, sf_dir):
    inter = S.subset(_cfg(spark, sf_dir), "intermediate").select("name")
    res = _vr(spark, sf_dir).join(inter, "name")
    return S.all_passed(_instances(spark, sf_dir), res)


@query("q_verifier_subset", ops="B3", views=("verifier_results", "verifier_config"), oracle="""
select 'intermediate' as schedule, r.instance_id, r.name
from verifier_results r join verifier_config c on c.name = r.name where c.run_intermediate
union all
select 'final', r.instance_id, r.name
from verifier_results r join verifier_config c on c.name = r.name where c.run_final
""")
def q_verifier_subset(spark, sf_dir):
    vr, cfg = _vr(spark, sf_dir), _cfg(spark, sf_dir)
    parts = []
    for which in ("intermediate", "final"):
        names = S.subset(cfg, which).select("name")
        parts.append(vr.join(names, "name")
                     .select(F.lit(which).alias("schedule"), "instance_id", "name"))
    return parts[0].unionByName(parts[1])


@query("q_verifier_modes", ops="B4", views=("verifier_results", "verifier_config"), oracle="""
select r.instance_id,
  count(*) filter (where c.mode = 'static') as static_results,
  count(*) filter (where c.mode = 'dynamic') as dynamic_results,
  bool_or(c.mode = 'dynamic') as is_dynamic
from verifier_results r join verifier_config c on c.name = r.name
group by r.instance_id
""")
def q_verifier_modes(spark, sf_dir):
    return S.split_by_mode(_vr(spark, sf_dir), _cfg(spark, sf_dir))


@query("q_safe_outcome", ops="B13", views=("verifier_results", "verifier_config"), oracle="""
select r.instance_id, r.name,
  case when r.wall_clock_seconds > coalesce(t.timeout_seconds, 60.0) then 'timeout'
       when r.status = 'error' then 'error' else r.status end as status,
  case when r.wall_clock_seconds > coalesce(t.timeout_seconds, 60.0) or r.status = 'error'
       then cast(0.0 as double) else r.score end as score,
  coalesce(c.pass_threshold, r.pass_threshold) as pass_threshold, r.wall_clock_seconds
from verifier_results r
left join verifier_config c on c.name = r.name
left join (values ('ast_check', cast(120.0 as double)), ('swe_test', cast(60.0 as double)))
  as t(name, timeout_seconds) on t.name = r.name
""")
def q_safe_outcome(spark, sf_dir):
    timeouts = spark.createDataFrame(list(S.VERIFIER_TIMEOUTS.items()),
                                     "name string, timeout_seconds double")
    return S.normalise_outcomes(_vr(spark, sf_dir), _cfg(spark, sf_dir), timeouts)


@query("q_outcome_notes", ops="B13", views=("noted_results", "verifier_config"), oracle="""
select r.instance_id, r.name,
  case when over then 'timeout' else r.status end as status,
  case when over or r.status = 'error' then cast(0.0 as double) else r.score end as score,
  c.pass_threshold, r.wall_clock_seconds,
  case when not over and r.status = 'error' and r.instance_id % 15 <> 0 then 'cannot read ' || r.instance_id end as error_message,
  case when not over and r.status = 'error' and r.instance_id % 15 <> 0
       then case when r.instance_id % 10 = 0 then 'OSError' else 'ValueError' end end as error_type,
  case when over then t.timeout_seconds end as limit_seconds
from noted_results r join verifier_config c on c.name = r.name
join (values ('ast_check', cast(120.0 as double)), ('swe_test', cast(60.0 as double)))
  as t(name, timeout_seconds) on t.name = r.name,
lateral (select r.wall_clock_seconds > t.timeout_seconds as over) o
""")
def q_outcome_notes(spark, sf_dir):
    """Normalised outcomes that keep the type and message of errors."""
    timeouts = spark.createDataFrame(list(S.VERIFIER_TIMEOUTS.items()),
                                     "name string, timeout_seconds double")
    return S.normalise_outcomes(fixture(spark, sf_dir, "noted_results"), _cfg(spark, sf_dir), timeouts)


def _recorded(spark, sf_dir):
    return fixture(spark, sf_dir, "recorded_results")


_FIRST = """
first as (
  select * from recorded_results qualify row_number() over (partition by instance_id, name order by pos) = 1)
"""


@query("q_results_in_order", ops="C5", views=("recorded_results", "verifier_config"), oracle=f"""
, {_FIRST}
select r.instance_id, c.ord, r.name, r.status, r.score, r.pass_threshold, r.details
from first r join verifier_config c on c.name = r.name
""")
def q_results_in_order(spark, sf_dir):
    return S.results_in_order(_recorded(spark, sf_dir), _cfg(spark, sf_dir))


@query("q_union_verifiers", ops="F2, B4, C5", views=("verifier_results", "verifier_config"), oracle="""
select r.instance_id, c.ord, r.name, c.mode,
  coalesce(r.status = 'ok' and r.score >= r.pass_threshold, false) as passed
from verifier_results r join verifier_config c on c.name = r.name
""")
def q_union_verifiers(spark, sf_dir):
    return S.static_then_dynamic(_vr(spark, sf_dir), _cfg(spark, sf_dir))


_LINE_SQL = """
'[' || r.name || '] ' || case when r.status <> 'ok' then upper(r.status)
  else (case when r.score >= r.pass_threshold then 'PASSED' else 'FAILED' end)
       || ' (score: ' || printf('%.2f', r.score) || ')' end
"""


@query("q_feedback_line", ops="G18", views=("verifier_results",), oracle=f"""
select r.instance_id, r.name, {_LINE_SQL} as feedback from verifier_results r
""")
def q_feedback_line(spark, sf_dir):
    vr = _vr(spark, sf_dir)
    return vr.select("instance_id", "name",
                     FB.feedback_line(F.col("name"), F.col("status"), F.col("score"),
                                      F.col("pass_threshold")).alias("feedback"))


_OWN_LINE_SQL = """
case when r.name = 'ast_check' then
  case when r.status <> 'ok' then '[ast_check] ' || upper(r.status)
    when r.score >= r.pass_threshold then '[ast_check] PASSED: no syntax errors detected'
    else '[ast_check] FAILED: syntax errors in the following files:' || chr(10) || '  - pkg/a' || r.instance_id || '.py: '
      || case when r.instance_id % 4 = 0 then '' else 'line ' || (r.instance_id % 4) end || ', offset 3: invalid syntax' end
else
  case when r.status <> 'ok' then '[swe_test] TIMEOUT: '
      || case when r.instance_id % 2 = 0 then 'no answer in time' else 'unknown error' end
    when r.score >= r.pass_threshold then '[swe_test] PASSED: issue resolved'
    else '[swe_test] FAILED (score: 0.29)' || chr(10) || case when r.instance_id % 2 = 0
      then '  Failing tests (2):' || chr(10) || '    - z' || chr(10) || '    - a'
      else '  The patch could not be applied to the repository.' end end
end
"""


@query("q_feedback_message", ops="G21, I1, C5", views=("recorded_results", "verifier_config"), oracle=f"""
, {_FIRST}
select r.instance_id,
  'Your solution was evaluated. Here is the feedback:' || chr(10) || chr(10)
  || string_agg({_OWN_LINE_SQL}, chr(10) order by c.ord) || chr(10) || chr(10)
  || case when bool_and(coalesce(r.status = 'ok' and r.score >= r.pass_threshold, false))
          then 'All checks passed.' else 'Please revise your solution to address the issues above.' end
  as feedback
from first r join verifier_config c on c.name = r.name and c.run_intermediate
group by r.instance_id
""")
def q_feedback_message(spark, sf_dir):
    inter = S.subset(_cfg(spark, sf_dir), "intermediate")
    return FB.feedback_message(S.results_in_order(_recorded(spark, sf_dir), inter))


@query("q_final_eval", ops="C6", views=("recorded_results",), oracle=f"""
, {_FIRST}
select i.instance_id, x.status, coalesce(x.status = 'ok', false) as has_report,
  coalesce(x.status = 'ok' and x.score >= 1.0, false) as resolved
from (select doc_id as instance_id from documents) i left join
  (select * from first where name = 'swe_test') x on x.instance_id = i.instance_id
""")
def q_final_eval(spark, sf_dir):
    from ..operators.reports import final_eval
    return final_eval(_instances(spark, sf_dir), _recorded(spark, sf_dir), "swe_test")


@query("q_final_eval_report", ops="C6, D7 (Q19)", views=("recorded_results",), oracle=f"""
, {_FIRST},
e as (
  select i.instance_id, x.status, coalesce(x.status = 'ok' and x.score >= 1.0, false) as resolved
  from (select doc_id as instance_id from documents) i left join
    (select * from first where name = 'swe_test') x on x.instance_id = i.instance_id)
select count(*) as instances, count(*) filter (where resolved) as resolved_instances,
  count(*) filter (where not resolved) as unresolved_instances,
  count(*) filter (where status is not null and status <> 'ok') as verifier_error_instances,
  count(*) filter (where status is null) as no_result_instances
from e
""")
def q_final_eval_report(spark, sf_dir):
    from ..operators.reports import final_eval, final_eval_report
    return final_eval_report(final_eval(_instances(spark, sf_dir), _recorded(spark, sf_dir), "swe_test"))
