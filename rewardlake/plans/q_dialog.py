"""Dialog and multi-turn queries: H1-H3, E1-E4, E13, G25, D8."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import dialog as DG
from ..sources import files as FS
from ..sources.fixtures import fixture
from ..sources.tables import table
from ..streaming.runner import new_area
from . import duck as D
from .registry import query

MAX_TURNS = 3


def _conv(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def _instances(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("instance_id")).distinct()


@query("q_conv_array", ops="H1", oracle="""
select conv_id, count(*) as n_messages, string_agg(role, ',' order by turn) as roles,
  string_agg(text, chr(10) order by turn) as texts
from conversations group by conv_id
""")
def q_conv_array(spark, sf_dir):
    c = DG.conversation_array(_conv(spark, sf_dir))
    return c.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"),
                    F.array_join("messages.role", ",").alias("roles"), F.array_join("messages.text", "\n").alias("texts"))


@query("q_turn_index", ops="E1", oracle="""
select conv_id, count(*) as n_messages,
  cast(floor((count(*) - case when arg_min(role, turn) = 'system' then 2 else 1 end) / 2.0) as bigint) as turn_index
from conversations group by conv_id
""")
def q_turn_index(spark, sf_dir):
    return DG.turn_index(_conv(spark, sf_dir))


_BLOCKS_SQL = """
m as (
  select conv_id, turn, role, text, row_number() over w - 1 as idx,
    case when first_value(role) over w = 'system' then 2 else 1 end as start, lag(role) over w as prev_role
  from conversations window w as (partition by conv_id order by turn)),
c as (
  select *, sum(case when idx >= start and role = 'assistant' then 1 else 0 end)
    over (partition by conv_id order by turn rows between unbounded preceding and current row) as attempt
  from m),
blocks as (
  select conv_id, turn, case when role = 'assistant' then 'attempt' else 'feedback' end as kind,
    cast(attempt as bigint) as attempt, text
  from c
  where (idx >= start and role = 'assistant')
     or (idx >= start and role = 'user' and prev_role = 'assistant' and idx - 1 >= start)),
hist as (
  select conv_id, string_agg(case when kind = 'attempt' then '### Attempt ' else '### Feedback on Attempt ' end
    || cast(attempt as varchar) || chr(10) || text, chr(10) || chr(10) order by turn) as history
  from blocks group by conv_id)
"""


@query("q_attempt_pairs", ops="E2", oracle=f"""
with {_BLOCKS_SQL}
select conv_id, turn, kind, attempt, text from blocks
""")
def q_attempt_pairs(spark, sf_dir):
    return DG.attempt_blocks(_conv(spark, sf_dir))


@query("q_history_text", ops="E2", oracle=f"""
with {_BLOCKS_SQL}
select conv_id, history from hist
""")
def q_history_text(spark, sf_dir):
    return DG.history_text(_conv(spark, sf_dir))


@query("q_augmented_problem", ops="G25, E1, E2", oracle=f"""
with {_BLOCKS_SQL},
ti as (select conv_id,
  cast(floor((count(*) - case when arg_min(role, turn) = 'system' then 2 else 1 end) / 2.0) as bigint) as turn_index
  from conversations group by conv_id),
pr as (select conv_id, arg_min(text, turn) as problem from conversations where role = 'user' group by conv_id)
select ti.conv_id, ti.turn_index,
  case when ti.turn_index > 0 and coalesce(h.history <> '', false)
       then coalesce(pr.problem, '') || {D.lit(DG.HISTORY_SEPARATOR)} || h.history
       else coalesce(pr.problem, '') end as problem_statement
from ti left join pr on pr.conv_id = ti.conv_id left join hist h on h.conv_id = ti.conv_id
""")
def q_augmented_problem(spark, sf_dir):
    return DG.augmented_problem(_conv(spark, sf_dir))


_FP = "(select instance_id, min(case when all_passed then turn end) as fp from turn_runs group by instance_id)"
_KEPT_SQL = f"""
kept as (
  select t.instance_id, cast(t.turn as bigint) as turn, t.output, t.aggregate_score, t.all_passed,
    coalesce(t.turn = f.fp, false) as exits,
    (not coalesce(t.turn = f.fp, false)) and t.turn < {MAX_TURNS - 1} as has_feedback
  from turn_runs t join {_FP} f on f.instance_id = t.instance_id
  where t.turn <= least(coalesce(f.fp, {MAX_TURNS - 1}), {MAX_TURNS - 1}))
"""


@query("q_early_exit", ops="E3", views=("turn_runs",), oracle=f"""
, {_KEPT_SQL}
select instance_id, turn, output, aggregate_score, exits, has_feedback from kept
""")
def q_early_exit(spark, sf_dir):
    k = DG.replay_early_exit(fixture(spark, sf_dir, "turn_runs"), MAX_TURNS)
    return k.select("instance_id", "turn", "output", "aggregate_score", "exits", "has_feedback")


_OUTCOMES_SQL = f"""
g as (
  select instance_id, count(*) as num_turns, bool_or(exits) as stopped_early, max(turn) as final_turn,
    arg_max(output, turn) as final_output, arg_max(aggregate_score, turn) as final_score,
    arg_max(all_passed, turn) as final_passed,
    arg_min(turn, struct_pack(a := -aggregate_score, b := turn)) as best_turn, max(aggregate_score) as best_score
  from kept group by instance_id),
o as (
  select i.instance_id, cast(coalesce(g.num_turns, 0) as bigint) as num_turns,
    coalesce(g.stopped_early, false) as stopped_early, g.final_turn, coalesce(g.final_output, '') as final_output,
    g.final_score, g.final_passed, g.best_turn, g.best_score
  from (select distinct conv_id as instance_id from conversations) i left join g on g.instance_id = i.instance_id)
"""


@query("q_final_turn", ops="E4, E3", views=("turn_runs",), oracle=f"""
, {_KEPT_SQL}, {_OUTCOMES_SQL}
select * from o
""")
def q_final_turn(spark, sf_dir):
    return DG.run_outcomes(_instances(spark, sf_dir), fixture(spark, sf_dir, "turn_runs"), MAX_TURNS)


@query("q_turn_rewards", ops="E13, E3", views=("turn_runs",), oracle=f"""
, {_KEPT_SQL}
select k.instance_id, k.turn,
  case when k.turn = l.last_turn then k.aggregate_score else 0.0 end as sparse_reward,
  k.aggregate_score - coalesce(lag(k.aggregate_score) over (partition by k.instance_id order by k.turn), 0.0)
    as dense_reward
from kept k join (select instance_id, max(turn) as last_turn from kept group by instance_id) l
  on l.instance_id = k.instance_id
""")
def q_turn_rewards(spark, sf_dir):
    return DG.turn_rewards(fixture(spark, sf_dir, "turn_runs"), MAX_TURNS)


@query("q_nest_turns", ops="H2", views=("turn_runs",), oracle="""
select instance_id, count(*) as num_turns, arg_min(output, turn) as first_output,
  arg_max(aggregate_score, turn) as last_score
from turn_runs group by instance_id
""")
def q_nest_turns(spark, sf_dir):
    n = DG.nest_turns(fixture(spark, sf_dir, "turn_runs"))
    return n.select("instance_id", "num_turns", F.element_at("turns", 1)["output"].alias("first_output"),
                    F.element_at("turns", -1)["aggregate_score"].alias("last_score"))


@query("q_unnest_turns", ops="H3, H2", views=("turn_runs",), oracle="""
select instance_id, cast(turn as bigint) as turn, output, aggregate_score, all_passed as passed from turn_runs
""")
def q_unnest_turns(spark, sf_dir):
    return DG.unnest_turns(DG.nest_turns(fixture(spark, sf_dir, "turn_runs")))


def _turn_checks(turns):
    """Two intermediate verifiers of every recorded turn."""
    n = F.length("output")
    checks = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("format_check").alias("name"),
                 F.when(n % 7 == 0, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
                 ((n % 4).cast("double") / 4).alias("score"), F.lit(0.5).alias("pass_threshold")),
        F.struct(F.lit(1).alias("ord"), F.lit("size_check").alias("name"), F.lit("ok").alias("status"),
                 F.col("aggregate_score").alias("score"), F.lit(0.75).alias("pass_threshold")))
    return turns.select("instance_id", "turn", F.explode(checks).alias("c")).select("instance_id", "turn", "c.*")


_RECORD_SQL = f"""
, {_KEPT_SQL},
checks as (
  select instance_id, cast(turn as bigint) as turn, 0 as ord, 'format_check' as name,
    case when length(output) % 7 = 0 then 'error' else 'ok' end as status,
    cast(length(output) % 4 as double) / 4 as score, cast(0.5 as double) as pass_threshold from turn_runs
  union all
  select instance_id, cast(turn as bigint), 1, 'size_check', 'ok', aggregate_score, cast(0.75 as double) from turn_runs),
judged as (select *, status = 'ok' and score >= pass_threshold as passed from checks),
told as (
  select instance_id, turn, 'Your solution was evaluated. Here is the feedback:' || chr(10) || chr(10)
    || string_agg('[' || name || '] ' || case when status <> 'ok' then upper(status)
         else case when passed then 'PASSED' else 'FAILED' end || ' (score: ' || printf('%.2f', score) || ')' end,
       chr(10) order by ord) || chr(10) || chr(10)
    || case when bool_and(passed) then 'All checks passed.'
            else 'Please revise your solution to address the issues above.' end as feedback
  from judged group by instance_id, turn),
runs as (select instance_id, count(*) as num_turns, bool_or(exits) as stopped_early from kept group by instance_id)
select k.instance_id, r.num_turns, r.stopped_early,
  case when f.resolved then cast(1.0 as double) when not f.resolved then cast(0.0 as double) end as final_aggregate_score,
  k.turn, k.output, case when k.has_feedback then t.feedback end as feedback, k.aggregate_score,
  j.name, j.status, j.score, j.passed
from kept k join runs r on r.instance_id = k.instance_id
join told t on t.instance_id = k.instance_id and t.turn = k.turn
join judged j on j.instance_id = k.instance_id and j.turn = k.turn
left join final_results f on f.instance_id = k.instance_id
"""


def _record(spark, sf_dir):
    turns = fixture(spark, sf_dir, "turn_runs")
    finals = fixture(spark, sf_dir, "final_results").select(
        "instance_id", F.when(F.col("resolved"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("final_aggregate_score"))
    return DG.multi_turn_record(turns, _turn_checks(turns), MAX_TURNS, finals)


@query("q_multi_turn_record", ops="H2, H3, E3, G21", views=("turn_runs", "final_results"), oracle=_RECORD_SQL)
def q_multi_turn_record(spark, sf_dir):
    return DG.unnest_record(_record(spark, sf_dir))


@query("q_sink_multi_turn", ops="A8, H2, H3", views=("turn_runs", "final_results"), oracle=_RECORD_SQL)
def q_sink_multi_turn(spark, sf_dir):
    root, record = new_area(spark, "sink-multi-turn"), _record(spark, sf_dir)
    results = record.select("instance_id", F.lit(None).cast("string").alias("error"), F.lit(True).alias("patch_exists"),
                            F.lit(None).cast("boolean").alias("resolved"))
    outputs = record.select("instance_id", F.element_at("turns", -1)["output"].alias("model_patch"),
                            F.lit("agent-model").alias("model_name_or_path"))
    FS.write_artifacts(results, outputs, None, root, "run-1", record)
    kind = T.StructType([f for f in record.schema if f.name != "instance_id"])
    stored = spark.read.parquet(f"{root}/multi_turn").select("instance_id", F.from_json("multi_turn", kind).alias("m"))
    return DG.unnest_record(stored.select("instance_id", "m.*"))


@query("q_run_summary", ops="D8, E3, E4, B11, C6", views=("turn_runs", "final_results"), oracle=f"""
, {_KEPT_SQL}, {_OUTCOMES_SQL},
r as (select o.*, num_turns = 0 as is_error, coalesce(f.resolved, false) as resolved
  from o left join final_results f on f.instance_id = o.instance_id)
select count(*) as total, count(*) filter (where is_error) as errors,
  count(*) filter (where not is_error and resolved is not null) as evaluated,
  case when count(*) > 0 then (count(*) filter (where not is_error and resolved is not null)) / count(*) else 0.0 end
    as completion_rate,
  count(*) filter (where not is_error and resolved is not null and resolved) as resolved,
  case when count(*) filter (where not is_error and resolved is not null) > 0
       then (count(*) filter (where not is_error and resolved is not null and resolved))
            / (count(*) filter (where not is_error and resolved is not null)) else 0.0 end as resolve_rate,
  avg(case when not is_error then (case when num_turns > 0 then num_turns else 1 end) end) as avg_turns,
  count(*) filter (where stopped_early) as early_exits,
  count(*) filter (where not is_error) as non_error_rows
from r
""")
def q_run_summary(spark, sf_dir):
    return DG.run_summary(_instances(spark, sf_dir), fixture(spark, sf_dir, "turn_runs"), MAX_TURNS,
                          fixture(spark, sf_dir, "final_results"))
