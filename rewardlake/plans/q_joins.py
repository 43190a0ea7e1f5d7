"""Scan, limit, resume, merge and grading queries: A1, A3, B1, B8, B9, B11,
C1, C3, C4, C8, C10, D17, F1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import sequence as SQ
from ..sources.fixtures import fixture
from ..sources.tables import table
from .registry import query

_PROMPTS_LOADED = """
select instance_id, pos, text_inputs from (
  select instance_id, pos, text_inputs,
    row_number() over (partition by instance_id order by pos desc) as rn
  from prompts
  where coalesce(instance_id <> '', false) and coalesce(text_inputs <> '', false)) x
where rn = 1
"""


@query("q_task_scan", ops="A1", views=("tasks",), oracle="""
select instance_id, pos, repo, problem_statement from tasks where split = 'test'
""")
def q_task_scan(spark, sf_dir):
    return (fixture(spark, sf_dir, "tasks").filter(F.col("split") == "test")
            .select("instance_id", "pos", "repo", "problem_statement"))


@query("q_limit", ops="B1", views=("tasks",), oracle="""
select instance_id, pos from tasks order by pos limit 10
""")
def q_limit(spark, sf_dir):
    # the instance limit is the feature: first n in dataset order (TakeOrdered)
    return SQ.first_n(fixture(spark, sf_dir, "tasks").select("instance_id", "pos"), "pos", 10)


@query("q_prompt_load", ops="A3, D17", views=("prompts",), oracle=_PROMPTS_LOADED)
def q_prompt_load(spark, sf_dir):
    return J.load_prompts(fixture(spark, sf_dir, "prompts"))


@query("q_last_wins", ops="D17", oracle="""
select user_id, event_id, ts, event_type, value from (
  select user_id, event_id, ts, event_type, value,
    row_number() over (partition by user_id order by ts desc, event_id desc) as rn
  from events) x where rn = 1
""")
def q_last_wins(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return J.last_wins(ev, "user_id", ["ts", "event_id"])


@query("q_resume_pending", ops="C1, F4, F1", views=("instance_results",), oracle="""
select cast(substr(r.instance_id, 7) as bigint) as pos, r.instance_id from instance_results r
where not exists (
  select 1 from instance_results d
  where d.instance_id = r.instance_id and cast(substr(d.instance_id, 7) as bigint) % 4 <> 3)
""")
def q_resume_pending(spark, sf_dir):
    # dataset = every graded instance; completed = what the three surviving
    # worker batches stored (batch 3 was lost), so the lost batch is pending
    res = fixture(spark, sf_dir, "instance_results").select("instance_id")
    dataset = res.withColumn("pos", F.substring(F.col("instance_id"), 7, 1_000_000).cast("bigint"))
    completed = J.union_results(*[dataset.filter(dataset.pos % 4 == b) for b in (0, 1, 2)])
    return J.resume_pending(dataset, completed).select("pos", "instance_id")


@query("q_missing_prompts", ops="C3", views=("tasks", "prompts"), oracle=f"""
select t.instance_id, t.pos from tasks t
where t.instance_id not in (select instance_id from ({_PROMPTS_LOADED}) p)
""")
def q_missing_prompts(spark, sf_dir):
    tasks = fixture(spark, sf_dir, "tasks").select("instance_id", "pos")
    return J.missing_prompts(tasks, J.load_prompts(fixture(spark, sf_dir, "prompts")))


@query("q_missing_first5", ops="C3 (first five shown)", views=("tasks", "prompts"), oracle=f"""
select t.pos, t.instance_id from tasks t
where t.instance_id not in (select instance_id from ({_PROMPTS_LOADED}) p)
order by t.pos limit 5
""")
def q_missing_first5(spark, sf_dir):
    tasks = fixture(spark, sf_dir, "tasks").select("instance_id", "pos")
    return J.first_missing(tasks, J.load_prompts(fixture(spark, sf_dir, "prompts")), 5)


@query("q_missing_prompt_rows", ops="B11, C3", views=("tasks", "prompts"), oracle=f"""
select t.instance_id, t.pos,
  case when p.text_inputs is null then 'No prompt found for instance' end as error,
  case when p.text_inputs is null then '' end as model_patch,
  'model-x' as model_name_or_path, p.text_inputs is not null as has_prompt
from tasks t left join ({_PROMPTS_LOADED}) p on p.instance_id = t.instance_id
""")
def q_missing_prompt_rows(spark, sf_dir):
    tasks = fixture(spark, sf_dir, "tasks")
    return J.prompt_or_error(tasks, J.load_prompts(fixture(spark, sf_dir, "prompts")), "model-x")


@query("q_sample_problem", ops="C4, D17", views=("code_samples", "problems"), oracle="""
select s.task_id, s.response, s.result, p.prompt, p.test, p.entry_point
from code_samples s join (
  select task_id, prompt, test, entry_point from (
    select *, row_number() over (partition by task_id order by pos desc) as rn from problems) x
  where rn = 1) p on p.task_id = s.task_id
""")
def q_sample_problem(spark, sf_dir):
    samples = fixture(spark, sf_dir, "code_samples").select("task_id", "response", "result")
    return J.samples_with_problems(samples, fixture(spark, sf_dir, "problems"))


@query("q_grade_tests", ops="C8", views=("tests",), oracle="""
select instance_id, bool_and(coalesce(status = 'PASSED', false)) as resolved,
  cast(sum(case when kind = 'FAIL_TO_PASS' and coalesce(status = 'PASSED', false) then 1 else 0 end) as bigint) as f2p_passed,
  cast(sum(case when kind = 'FAIL_TO_PASS' then 1 else 0 end) as bigint) as f2p_total,
  cast(sum(case when kind <> 'FAIL_TO_PASS' and coalesce(status = 'PASSED', false) then 1 else 0 end) as bigint) as p2p_passed,
  cast(sum(case when kind <> 'FAIL_TO_PASS' then 1 else 0 end) as bigint) as p2p_total
from tests group by instance_id
""")
def q_grade_tests(spark, sf_dir):
    return J.grade_tests(fixture(spark, sf_dir, "tests"))


@query("q_grade_predictions", ops="C8", views=("tests",), oracle="""
select o_orderkey as instance_id, o_orderkey % 10 <> 0 as patch_exists,
  o_orderkey % 10 <> 0 and o_orderkey % 13 <> 0 and coalesce(t.ok, false) as resolved,
  case when o_orderkey % 13 = 0 then 'no report' end as error
from orders left join (select instance_id, bool_and(coalesce(status = 'PASSED', false)) as ok from tests
  group by instance_id) t on t.instance_id = o_orderkey
""")
def q_grade_predictions(spark, sf_dir):
    key = F.col("o_orderkey")
    patch = F.when(key % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("diff "), key.cast("string")))
    predictions = table(spark, sf_dir, "orders").select(
        key.alias("instance_id"), patch.alias("model_patch"), F.when(key % 13 == 0, F.lit("no report")).alias("error"))
    return J.grade_predictions(fixture(spark, sf_dir, "tests"), predictions)


@query("q_patches_generated", ops="C10", views=("tasks", "instance_results"), oracle="""
select count(*) as patches_generated from tasks t
where exists (select 1 from instance_results r where r.instance_id = t.instance_id)
""")
def q_patches_generated(spark, sf_dir):
    return J.patches_generated(fixture(spark, sf_dir, "tasks"), fixture(spark, sf_dir, "instance_results"))


_ALIAS_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in J.DATASET_ALIASES)
_ALIAS_NAMES = ", ".join(f"'{a}'" for a, _ in J.DATASET_ALIASES)


def _dataset_names(nation):
    """A dataset name per nation: most nations name a known dataset, every
    third one carries its own (unknown) name."""
    known = F.array(*[F.lit(a) for a, _ in J.DATASET_ALIASES])
    return nation.select(
        "n_nationkey",
        F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name"))
        .otherwise(F.element_at(known, (F.col("n_nationkey") % 13 + 1).cast("int"))).alias("dataset"))


@query("q_alias_map", ops="B8", oracle=f"""
select d.n_nationkey, d.dataset, coalesce(a.s, d.dataset) as subset
from (select n_nationkey,
        case when n_nationkey % 3 = 0 then n_name
             else list_extract([{_ALIAS_NAMES}], cast(n_nationkey % 13 + 1 as integer)) end as dataset
      from nation) d
left join (values {_ALIAS_VALUES}) as a(n, s) on a.n = d.dataset
""")
def q_alias_map(spark, sf_dir):
    return J.resolve_alias(_dataset_names(table(spark, sf_dir, "nation")), "dataset")


@query("q_round_robin", ops="B9", oracle="""
select o_orderkey, o_custkey,
  cast((row_number() over (partition by o_custkey order by o_orderkey) - 1) % 4 as bigint) as worker
from orders
""")
def q_round_robin(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return SQ.round_robin(orders, "o_custkey", "o_orderkey", 4)


@query("q_union_results", ops="F1, B11", views=("instance_results",), oracle="""
select r.instance_id, b.instance_id is not null as returned, b.batch
from instance_results r left join (
  select instance_id, cast(substr(instance_id, 7) as bigint) % 4 as batch from instance_results
  where cast(substr(instance_id, 7) as bigint) % 4 <> 3) b on b.instance_id = r.instance_id
""")
def q_union_results(spark, sf_dir):
    res = fixture(spark, sf_dir, "instance_results").select("instance_id")
    batch = (F.substring(F.col("instance_id"), 7, 1_000_000).cast("bigint") % 4)
    tagged = res.withColumn("batch", batch)
    # four worker batches; batch 3 failed as a whole and returned nothing
    returned = J.union_results(*[tagged.filter(F.col("batch") == b) for b in (0, 1, 2)])
    return (res.join(returned, "instance_id", "left")
            .select("instance_id", F.col("batch").isNotNull().alias("returned"), "batch"))
