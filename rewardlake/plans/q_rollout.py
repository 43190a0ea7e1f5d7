"""Rollout queries: D13, E5-E7, E12, G37."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import rollout as RO
from ..operators import sequence as SQ
from ..sources.fixtures import fixture
from ..sources.tables import table
from . import duck as D
from .registry import query

_TERM_SQL = f"""
term as (
  select episode, cast(least(coalesce(fs, {RO.MAX_STEPS}), {RO.MAX_STEPS}) as integer) as end_step,
    (fs is null or fs > {RO.MAX_STEPS}) as forced
  from (select episode, min(case when action = 'submit' then step end) as fs, max(step) as ls
        from steps group by episode) g
  where fs is not null or ls >= {RO.MAX_STEPS}),
cut as (
  select s.episode, s.step, s.action, s.exit_code, s.stdout,
    coalesce(s.step = t.end_step, false) as is_terminal,
    coalesce(t.forced and s.step = t.end_step, false) as forced_submit
  from steps s left join term t on t.episode = s.episode
  where t.end_step is null or s.step <= t.end_step)
"""


@query("q_episode_cut", ops="E7", views=("steps",), oracle=f"""
, {_TERM_SQL}
select episode, step, action, is_terminal, forced_submit from cut
""")
def q_episode_cut(spark, sf_dir):
    c = RO.cut_episodes(fixture(spark, sf_dir, "steps"))
    return c.select("episode", F.col("step").cast("bigint").alias("step"), "action", "is_terminal", "forced_submit")


@query("q_step_machine", ops="E7", views=("steps",), oracle=f"""
, {_TERM_SQL}
select c.episode, s.event_id, cast(c.step as bigint) as step, c.action, c.is_terminal, c.forced_submit
from cut c join steps s on s.episode = c.episode and s.step = c.step
""")
def q_step_machine(spark, sf_dir):
    """E7 on the raw event log: one scan numbers and ends the episodes."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "purchase", F.lit("submit")).otherwise(F.lit("bash"))
    log = e.select(F.col("user_id").alias("episode"), "event_id", "ts", action.alias("action"))
    return RO.cut_log(log, ["ts", "event_id"]).select("episode", "event_id", "step", "action", "is_terminal", "forced_submit")


def _episode_patches(spark, sf_dir):
    p = fixture(spark, sf_dir, "patches")
    return p.select(F.substring("instance_id", 7, 1 << 20).cast("bigint").alias("episode"), "patch")


def _episode_grades(spark, sf_dir):
    g = J.grade_tests(fixture(spark, sf_dir, "tests"))
    return g.select(F.col("instance_id").alias("episode"), "resolved")


_SP = D.strip("coalesce(p.patch, '')")
_GITS = f"list_filter({D.split_lines(_SP)}, lambda l: starts_with(l, 'diff --git '))"


@query("q_episode_summary", ops="D13, E7, D19, C8", views=("steps", "patches", "tests"), oracle=f"""
, {_TERM_SQL},
done as (select episode, step as steps from cut where is_terminal),
cnt as (select episode, count(*) filter (where exit_code <> 0) as nz, sum(length(stdout)) as chars
        from cut where not is_terminal group by episode),
p as (select cast(substr(instance_id, 7) as bigint) as episode, patch from patches),
gr as (select instance_id as episode, bool_and(coalesce(status = 'PASSED', false)) as resolved
       from tests group by instance_id)
select d.episode, cast(d.steps as bigint) as steps, cast(coalesce(c.nz, 0) as bigint) as nonzero_exits,
  cast(coalesce(c.chars, 0) as bigint) as total_output_chars,
  cast(case when coalesce(p.patch, '') <> '' then length({_SP}) - length(replace({_SP}, chr(10), '')) else 0 end
       as bigint) as patch_lines,
  cast(case when coalesce(p.patch, '') <> '' then coalesce(len(list_distinct(list_filter(list_transform({_GITS},
    lambda l: case when strpos(l, ' b/') > 0 then substring(l, strpos(l, ' b/') + 3) end), lambda x: x is not null))), 0)
    else 0 end as bigint) as files_changed,
  cast(case when coalesce(p.patch, '') <> '' then 0.0 else 1.0 end as double) as empty_patch,
  cast(case when d.steps <= 1 then 1.0 else 0.0 end as double) as immediate_submit,
  cast(case when coalesce(p.patch, '') <> '' and coalesce(gr.resolved, false) then 1.0 else 0.0 end as double) as reward
from done d left join cnt c on c.episode = d.episode left join p on p.episode = d.episode
left join gr on gr.episode = d.episode
""")
def q_episode_summary(spark, sf_dir):
    return RO.episode_summary(fixture(spark, sf_dir, "steps"), _episode_patches(spark, sf_dir),
                              _episode_grades(spark, sf_dir))


@query("q_retry", ops="E5", views=("attempts",), oracle=f"""
select rollout_id, cast(r.a as bigint) as used_attempt, r.w as reward, r is null as discarded
from (select rollout_id,
        min(case when attempt <= {RO.MAX_RETRIES + 1} and not infra_error then struct_pack(a := attempt, w := reward) end) as r
      from attempts group by rollout_id) x
""")
def q_retry(spark, sf_dir):
    return RO.resolve_retries(fixture(spark, sf_dir, "attempts"))


@query("q_group_advantage", ops="E6", views=("rollouts",), oracle=f"""
select r.prompt_id, r.sample, r.reward,
  round((r.reward - g.m) / (g.s + {RO.ADV_EPS}), 9) as advantage
from rollouts r join (select prompt_id, avg(reward) as m, coalesce(stddev_samp(reward), 0.0) as s
                      from rollouts group by prompt_id) g on g.prompt_id = r.prompt_id
""")
def q_group_advantage(spark, sf_dir):
    a = RO.group_advantage(fixture(spark, sf_dir, "rollouts"))
    return a.select("prompt_id", "sample", "reward", F.round("advantage", 9).alias("advantage"))


@query("q_elapsed", ops="G37", views=("steps",), oracle="""
select episode, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as elapsed_seconds,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 60.0, 1) as elapsed_minutes
from steps group by episode
""")
def q_elapsed(spark, sf_dir):
    return RO.elapsed(fixture(spark, sf_dir, "steps"))


@query("q_first_success", ops="E12", views=("apply_attempts",), oracle="""
select instance_id, coalesce(arg_min(method, ord) filter (where ok), 'failed') as method
from apply_attempts group by instance_id
""")
def q_first_success(spark, sf_dir):
    a = fixture(spark, sf_dir, "apply_attempts")
    return SQ.first_success(a, "instance_id", "ord", "method", F.col("ok"))
