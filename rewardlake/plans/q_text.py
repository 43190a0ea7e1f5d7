"""Text queries: G1-G6, G10-G17, G22-G35, B2, C2, D10, D11, H4, H5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import variant as V
from ..operators import answers as AN
from ..operators import joins as J
from ..operators import logs as LG
from ..operators import reports as R
from ..sources.fixtures import fixture
from ..sources.tables import table
from . import duck as D
from .registry import query

# ------------------------------------------------------------- math answers
_RESP = "(case when starts_with(query, prompt) then substring(query, length(prompt) + 1) else query end)"


def _extract_sql(x: str) -> str:
    boxed = D.strip(D.last_match(x, T.BOXED, 1))
    hashed = D.strip(f"replace({D.last_match(x, T.HASH_ANSWER, 1)}, ',', '')")
    number = D.strip(f"replace({D.last_match(x, T.LAST_NUMBER, 0)}, ',', '')")
    return f"coalesce({boxed}, {hashed}, {number})"


def _norm_sql(x: str) -> str:
    s = D.strip(f"replace({x}, ',', '')")
    return f"(case when regexp_matches({s}, {D.lit(T.FLOAT_TEXT)}) then try_cast({s} as double) end)"


_PRED = _norm_sql(_extract_sql(_RESP))
_GOLD_TXT = f"(case when {D.truthy('label')} then {_extract_sql('label')} end)"
_GOLD = f"(case when {D.truthy(_GOLD_TXT)} then {_norm_sql(_GOLD_TXT)} else {_norm_sql('label')} end)"
_REWARD = (f"(case when {_PRED} is not null and {_GOLD} is not null and not isnan({_PRED}) "
           f"and not isnan({_GOLD}) and abs({_PRED} - {_GOLD}) < 1e-6 then 1.0 else 0.0 end)")


def _answers(spark, sf_dir):
    a = fixture(spark, sf_dir, "answers")
    return a.withColumn("response", T.strip_prompt(F.col("query"), F.col("prompt")))


@query("q_strip_prompt", ops="G4", views=("answers",), oracle=f"""
select prompt_id, sample, {_RESP} as response from answers
""")
def q_strip_prompt(spark, sf_dir):
    return _answers(spark, sf_dir).select("prompt_id", "sample", "response")


@query("q_answer_extract", ops="G1", views=("answers",), oracle=f"""
select prompt_id, sample, {_extract_sql(_RESP)} as pred from answers
""")
def q_answer_extract(spark, sf_dir):
    return _answers(spark, sf_dir).select("prompt_id", "sample", T.extract_answer("response").alias("pred"))


@query("q_answer_number", ops="G2", views=("answers",), oracle=f"""
select prompt_id, sample, {_PRED} as pred_num from answers
""")
def q_answer_number(spark, sf_dir):
    return _answers(spark, sf_dir).select(
        "prompt_id", "sample", T.normalize_number(T.extract_answer("response")).alias("pred_num"))


@query("q_answer_reward", ops="G3, G4", views=("answers",), oracle=f"""
select prompt_id, sample, cast({_REWARD} as double) as reward from answers
""")
def q_answer_reward(spark, sf_dir):
    return AN.score_answers(fixture(spark, sf_dir, "answers")).select("prompt_id", "sample", "reward")


@query("q_answer_accuracy", ops="D11", views=("answers",), oracle=f"""
select count(*) as n_samples, avg(cast({_REWARD} as double)) as accuracy from answers
""")
def q_answer_accuracy(spark, sf_dir):
    return AN.accuracy(AN.score_answers(fixture(spark, sf_dir, "answers")))


# ------------------------------------------------------------- responses
_FENCE_START = "strpos(response, '```python')"
_FENCE_E = f"strpos(substring(response, {_FENCE_START} + 9), '```')"
_CODE = (f"(case when {_FENCE_START} = 0 then response "
         f"when {_FENCE_E} = 0 then {D.substr_from('response', _FENCE_START + ' + 9')} "
         f"else substring(response, {_FENCE_START} + 9, {_FENCE_E} - 1) end)")


@query("q_code_fence", ops="G5", views=("code_samples",), oracle=f"""
select task_id, {_CODE} as code from code_samples
""")
def q_code_fence(spark, sf_dir):
    return fixture(spark, sf_dir, "code_samples").select("task_id", T.code_fence("response").alias("code"))


@query("q_extract_diff", ops="G6", views=("code_samples",), oracle=f"""
select task_id, coalesce(
  nullif(regexp_extract(response, '(?s)<patch>(.*?)</patch>', 1), ''),
  nullif(regexp_extract(response, '(?s)<diff>(.*?)</diff>', 1), ''),
  nullif(regexp_extract(response, '(?s)```diff\\n(.*?)```', 1), ''),
  nullif(split_part(response, '</s>', 1), ''),
  {D.strip('response')}) as patch
from code_samples
""")
def q_extract_diff(spark, sf_dir):
    from ..functions.patch import extract_diff
    return fixture(spark, sf_dir, "code_samples").select("task_id", extract_diff("response").alias("patch"))


@query("q_outcome_label", ops="G33", views=("code_samples",), oracle=f"""
select task_id, result = 'passed' as passed,
  case when not {D.truthy('result')} then 'timed out' when result = 'passed' then 'passed'
       when result = 'timed out' then 'timed out' else 'failed' end as outcome
from code_samples
""")
def q_outcome_label(spark, sf_dir):
    s = fixture(spark, sf_dir, "code_samples")
    return s.select("task_id", (F.col("result") == "passed").alias("passed"),
                    T.outcome_label("result").alias("outcome"))


_PROBLEMS_LAST = """
(select task_id, prompt, test, entry_point from (
  select *, row_number() over (partition by task_id order by pos desc) as rn from problems) x where rn = 1)
"""


@query("q_check_program", ops="G32, G5, C4", views=("code_samples", "problems"), oracle=f"""
select s.task_id, p.prompt || {_CODE.replace('response', 's.response')} || chr(10) || p.test || chr(10)
  || 'check(' || p.entry_point || ')' as program
from code_samples s join {_PROBLEMS_LAST} p on p.task_id = s.task_id
""")
def q_check_program(spark, sf_dir):
    s = fixture(spark, sf_dir, "code_samples").select("task_id", T.code_fence("response").alias("completion"))
    j = J.samples_with_problems(s, fixture(spark, sf_dir, "problems"))
    return j.select("task_id", T.check_program(F.col("prompt"), F.col("completion"), F.col("test"),
                                               F.col("entry_point")).alias("program"))


@query("q_completion_report", ops="D10, C4, G33", views=("code_samples", "problems"), oracle=f"""
select count(*) as total, count(*) filter (where s.result = 'passed') as passed,
  count(*) filter (where s.result <> 'passed' or s.result is null) as failed,
  case when count(*) > 0 then cast(count(*) filter (where s.result = 'passed') as double) / count(*) else 0.0 end
    as pass_rate
from code_samples s join {_PROBLEMS_LAST} p on p.task_id = s.task_id
""")
def q_completion_report(spark, sf_dir):
    s = fixture(spark, sf_dir, "code_samples").select("task_id", "result")
    j = J.samples_with_problems(s, fixture(spark, sf_dir, "problems"))
    ok = F.coalesce(F.col("result") == "passed", F.lit(False))
    return (j.agg(F.count(F.lit(1)).alias("total"), R.count_where(ok).alias("passed"),
                  R.count_where(~ok).alias("failed"))
            .withColumn("pass_rate", R.safe_ratio(F.col("passed"), F.col("total"))))


@query("q_completion_results", ops="D10 id lists", views=("code_samples", "problems"), oracle=f"""
select s.task_id, s.result, coalesce(s.result = 'passed', false) as passed,
  case when s.result = 'passed' then 'passed_ids' else 'failed_ids' end as list_name
from code_samples s join {_PROBLEMS_LAST} p on p.task_id = s.task_id
""")
def q_completion_results(spark, sf_dir):
    s = fixture(spark, sf_dir, "code_samples").select("task_id", "result")
    return R.completion_results(J.samples_with_problems(s, fixture(spark, sf_dir, "problems")))


# ------------------------------------------------------------- job logs
def _preds_sql(model: str) -> str:
    raw = D.between("logs", T.PREDS_START, T.PREDS_END)
    j = f"(case when json_valid({raw}) then {raw} end)"
    ok = f"coalesce(json_type({j}) = 'OBJECT', false)"
    own = f"json_extract({j}, '$.\"' || instance_id || '\"')"
    own_id = f"json_extract_string({own}, '$.instance_id')"
    single = f"({ok} and len(json_keys({j})) = 1)"
    only = f"json_extract({j}, '$.\"' || json_keys({j})[1] || '\"')"
    return f"""
  case when {ok} and {own} is not null then
         case when {own_id} is not null then {own_id} else instance_id end
       when {single} then coalesce(json_extract_string({only}, '$.instance_id'), instance_id)
       else instance_id end as pred_instance_id,
  case when {ok} and {own} is not null then
         case when {own_id} is not null then coalesce(json_extract_string({own}, '$.model_patch'), '') else '' end
       when {single} then coalesce(json_extract_string({only}, '$.model_patch'), '')
       else '' end as model_patch,
  case when {ok} and {own} is not null then
         case when {own_id} is not null then coalesce(json_extract_string({own}, '$.model_name_or_path'), {model})
              else {model} end
       when {single} then coalesce(json_extract_string({only}, '$.model_name_or_path'), {model})
       else {model} end as model_name_or_path"""


@query("q_logs_patch", ops="G11", views=("logs",), oracle=f"""
select instance_id, {D.between('logs', T.PATCH_START, T.PATCH_END)} as patch,
  {D.between('logs', T.EVAL_START, T.EVAL_END)} as eval_output,
  {D.between('logs', T.TRAJ_START, T.TRAJ_END)} as trajectory
from logs
""")
def q_logs_patch(spark, sf_dir):
    lg = fixture(spark, sf_dir, "logs")
    return lg.select("instance_id", T.log_patch("logs").alias("patch"),
                     T.log_eval_output("logs").alias("eval_output"),
                     T.log_trajectory("logs").alias("trajectory"))


@query("q_logs_preds", ops="G12", views=("logs",), oracle=f"""
select instance_id, {_preds_sql("'agent-model'")} from logs
""")
def q_logs_preds(spark, sf_dir):
    lg = fixture(spark, sf_dir, "logs")
    p = T.log_predictions("logs", F.col("instance_id"), F.lit("agent-model"))
    return lg.select("instance_id", p.alias("p")).select(
        "instance_id", F.col("p.instance_id").alias("pred_instance_id"), "p.model_patch", "p.model_name_or_path")


@query("q_pred_defaults", ops="B2, G12", views=("logs",), oracle=f"""
select instance_id, pred_instance_id, coalesce(model_patch, '') as model_patch,
  coalesce(model_name_or_path, 'unknown') as model_name_or_path
from (select instance_id, {_preds_sql('cast(null as varchar)')} from logs) x
""")
def q_pred_defaults(spark, sf_dir):
    lg = fixture(spark, sf_dir, "logs")
    p = T.log_predictions("logs", F.col("instance_id"), F.lit(None).cast("string"))
    return lg.select("instance_id", p.alias("p")).select(
        "instance_id", F.col("p.instance_id").alias("pred_instance_id"),
        F.coalesce(F.col("p.model_patch"), F.lit("")).alias("model_patch"),
        F.coalesce(F.col("p.model_name_or_path"), F.lit("unknown")).alias("model_name_or_path"))


AGENTS = [("mini", "preds_json:preds.json"), ("raw-agent", "raw_patch")]


@query("q_logs_dispatch", ops="G13, G11, G12", views=("logs",), oracle=f"""
select 'mini' as agent, instance_id, {_preds_sql("'agent-model'")} from logs
union all
select 'raw-agent', instance_id, instance_id, {D.between('logs', T.PATCH_START, T.PATCH_END)}, 'agent-model'
from logs
""")
def q_logs_dispatch(spark, sf_dir):
    return LG.dispatch(fixture(spark, sf_dir, "logs"), dict(AGENTS)).drop("apply_status")


MORE_AGENTS = {"mini": "preds_json:preds.json", "mini-v2": "preds_json:out/preds.json", "raw-agent": "raw_patch", "diff": "git_diff"}


@query("q_logs_agents", ops="G13, G11, G12, G30", views=("logs",), oracle=f"""
select agent, instance_id, apply_status,
  case when json then pred_instance_id else instance_id end as pred_instance_id,
  case when json then model_patch else patch end as model_patch,
  case when json then model_name_or_path else 'agent-model' end as model_name_or_path
from (select instance_id, {D.between('logs', T.PATCH_START, T.PATCH_END)} as patch, {_preds_sql("'agent-model'")},
        case when strpos(logs, {D.lit(T.APPLY_FAILED)}) > 0 then 'failed'
             when strpos(logs, {D.lit(T.APPLIED)}) > 0 then 'applied' else 'unknown' end as apply_status from logs) l,
  (values ('mini', true), ('mini-v2', true), ('raw-agent', false), ('diff', false)) as a(agent, json)
""")
def q_logs_agents(spark, sf_dir):
    """Four agents' predictions and the apply status from one scan."""
    return LG.dispatch(fixture(spark, sf_dir, "logs"), MORE_AGENTS)


@query("q_apply_marker", ops="G30", views=("logs",), oracle=f"""
select instance_id, case when strpos(logs, {D.lit(T.APPLY_FAILED)}) > 0 then 'failed'
  when strpos(logs, {D.lit(T.APPLIED)}) > 0 then 'applied' else 'unknown' end as apply_status
from logs
""")
def q_apply_marker(spark, sf_dir):
    return fixture(spark, sf_dir, "logs").select("instance_id", T.apply_status("logs").alias("apply_status"))


@query("q_merge_predictions", ops="C2, G13, G30", views=("tasks", "logs"), oracle=f"""
select t.pos, t.instance_id, coalesce(p.model_patch, '') as model_patch,
  coalesce(p.model_name_or_path, 'unknown') as model_name_or_path
from tasks t join (
  select instance_id, {D.between('logs', T.PATCH_START, T.PATCH_END)} as model_patch, 'agent-model' as model_name_or_path
  from logs where strpos(logs, {D.lit(T.APPLY_FAILED)}) = 0) p on p.instance_id = t.instance_id
""")
def q_merge_predictions(spark, sf_dir):
    lg = fixture(spark, sf_dir, "logs")
    stored = (lg.filter(T.apply_status("logs") != "failed")
              .select("instance_id", T.log_patch("logs").alias("model_patch"),
                      F.lit("agent-model").alias("model_name_or_path")))
    return J.merge_predictions(fixture(spark, sf_dir, "tasks"), stored)


# ------------------------------------------------------------- tool calls
_BASH_FULL = f"regexp_extract(action_text, {D.lit(T.BASH_CALL)}, 0)"
_BASH_AT = f"(case when {_BASH_FULL} <> '' then strpos(action_text, {_BASH_FULL}) else 0 end)"
_SUB_FULL = f"regexp_extract(action_text, {D.lit(T.SUBMIT_CALL)}, 0)"
_SUB_AT = f"(case when {_SUB_FULL} <> '' then strpos(action_text, {_SUB_FULL}) else 0 end)"
_KIND = (f"(case when {_BASH_AT} > 0 and {_SUB_AT} > 0 then (case when {_BASH_AT} < {_SUB_AT} then 'bash' else 'submit' end) "
         f"when {_SUB_AT} > 0 then 'submit' when {_BASH_AT} > 0 then 'bash' "
         f"when {D.strip('action_text')} <> '' then 'bash' else 'submit' end)")


@query("q_tool_call", ops="G14", views=("tool_texts",), oracle=f"""
select event_id, {_KIND} as call_type,
  case when {_KIND} = 'submit' then '' when {_BASH_AT} > 0
       then {D.strip(f"regexp_extract(action_text, {D.lit(T.BASH_CALL)}, 1)")}
       else {D.strip('action_text')} end as content
from tool_texts
""")
def q_tool_call(spark, sf_dir):
    t = fixture(spark, sf_dir, "tool_texts")
    return t.select("event_id", T.tool_call("action_text").alias("c")).select(
        "event_id", F.col("c.type").alias("call_type"), F.col("c.content").alias("content"))


_RC_FULL = f"regexp_extract(raw_output, {D.lit(T.RC_SENTINEL)}, 0)"
_RC_AT = f"strpos(raw_output, {_RC_FULL})"


@query("q_exit_code", ops="G17", views=("tool_texts",), oracle=f"""
select event_id,
  case when {_RC_FULL} <> '' then {D.strip(f"left(raw_output, {_RC_AT} - 1) || {D.substr_from('raw_output', f'{_RC_AT} + length({_RC_FULL})')}")}
       else raw_output end as output,
  case when {_RC_FULL} <> '' then try_cast(regexp_extract(raw_output, {D.lit(T.RC_SENTINEL)}, 1) as bigint)
       else cast(-1 as bigint) end as exit_code
from tool_texts
""")
def q_exit_code(spark, sf_dir):
    t = fixture(spark, sf_dir, "tool_texts")
    return t.select("event_id", T.exit_code_split("raw_output").alias("r")).select(
        "event_id", "r.output", "r.exit_code")


@query("q_think_flag", ops="G31", views=("steps", "tool_texts"), oracle="""
select s.episode, strpos(t.action_text, '<think>') > 0 as thinking_on
from steps s join tool_texts t on t.event_id = s.event_id where s.step = 1
""")
def q_think_flag(spark, sf_dir):
    s = fixture(spark, sf_dir, "steps").filter(F.col("step") == 1).select("episode", "event_id")
    t = fixture(spark, sf_dir, "tool_texts").select("event_id", "action_text")
    return s.join(t, "event_id").select(
        "episode", F.contains(F.col("action_text"), F.lit("<think>")).alias("thinking_on"))


def _trunc_sql(x: str, limit: int = 8000) -> str:
    h = limit // 2
    return (f"(case when length({x}) <= {limit} then {x} else left({x}, {h}) || chr(10) || '... (' "
            f"|| cast(length({x}) - {limit} as varchar) || ' chars truncated) ...' || chr(10) || right({x}, {h}) end)")


@query("q_truncate", ops="G15", oracle=f"""
select doc_id, {_trunc_sql('text')} as text_out from documents
""")
def q_truncate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.truncate_middle("text", 8000).alias("text_out"))


@query("q_tool_output", ops="G16, G15", views=("steps",), oracle=f"""
select episode, step, {_trunc_sql('stdout')}
  || case when exit_code <> 0 then chr(10) || '[exit code: ' || cast(exit_code as varchar) || ']' else '' end
  as feedback
from steps
""")
def q_tool_output(spark, sf_dir):
    s = fixture(spark, sf_dir, "steps")
    return s.select("episode", F.col("step").cast("bigint").alias("step"),
                    T.tool_output("stdout", "exit_code").alias("feedback"))


# ------------------------------------------------------------- templates, keys
_TEMPLATE = "cd /work/{repo} && run --id {instance_id} --split {split} --keep {unknown}"


@query("q_template", ops="G22", views=("tasks",), oracle=f"""
select instance_id, replace(replace(replace({D.lit(_TEMPLATE)}, '{{repo}}', repo),
  '{{instance_id}}', instance_id), '{{split}}', split) as command
from tasks
""")
def q_template(spark, sf_dir):
    t = fixture(spark, sf_dir, "tasks")
    cmd = T.render_template(F.lit(_TEMPLATE), {"repo": F.col("repo"), "instance_id": F.col("instance_id"),
                                               "split": F.col("split")})
    return t.select("instance_id", cmd.alias("command"))


@query("q_task_prompt", ops="G23", views=("tasks",), oracle=f"""
select instance_id, {D.lit(T.TASK_PROMPT)} || problem_statement as prompt from tasks
""")
def q_task_prompt(spark, sf_dir):
    return fixture(spark, sf_dir, "tasks").select("instance_id", T.task_prompt(F.col("problem_statement")).alias("prompt"))


_P_LOADED = """
(select instance_id, pos, text_inputs from (
  select instance_id, pos, text_inputs, row_number() over (partition by instance_id order by pos desc) as rn
  from prompts where coalesce(instance_id <> '', false) and coalesce(text_inputs <> '', false)) x where rn = 1)
"""


@query("q_initial_messages", ops="G24, A3", views=("prompts",), oracle=f"""
select instance_id, 0 as msg_idx, 'system' as role, left(text_inputs, strpos(text_inputs, chr(10)) - 1) as content
from {_P_LOADED} p where strpos(text_inputs, chr(10)) > 0
union all
select instance_id, 1, 'user', substring(text_inputs, strpos(text_inputs, chr(10)) + 1)
from {_P_LOADED} p where strpos(text_inputs, chr(10)) > 0
union all
select instance_id, 0, 'user', text_inputs from {_P_LOADED} p where strpos(text_inputs, chr(10)) = 0
""")
def q_initial_messages(spark, sf_dir):
    p = J.load_prompts(fixture(spark, sf_dir, "prompts"))
    return (p.select("instance_id", F.posexplode(T.initial_messages("text_inputs")).alias("msg_idx", "m"))
            .select("instance_id", "msg_idx", "m.role", "m.content"))


@query("q_run_key", ops="G26", views=("tasks",), oracle="""
select instance_id,
  'swe-' || regexp_replace(left(replace(replace(lower(instance_id), '__', '-'), '_', '-'), 52), '^-+|-+$', '', 'g')
  || '-' || left(md5(instance_id || '-' || 'run-7'), 6) as job_name,
  left(instance_id, 63) as job_label
from tasks
""")
def q_run_key(spark, sf_dir):
    t = fixture(spark, sf_dir, "tasks")
    return t.select("instance_id", T.run_key(F.col("instance_id"), F.lit("run-7")).alias("job_name"),
                    F.left(F.col("instance_id"), F.lit(63)).alias("job_label"))


_REG = "registry.local:5000/agents"
_NAME = f"(case when strpos(image, '/') > 0 then {D.substr_from('image', 'strpos(image, chr(47)) + 1')} else image end)"


@query("q_image_rewrite", ops="G27", views=("images",), oracle=f"""
select pos, image,
  '{_REG}/' || case when ends_with({_NAME}, ':latest') then left({_NAME}, length({_NAME}) - 7) || ':v1' else {_NAME} end
    as worker_ref,
  '{_REG}/' || case when ends_with({_NAME}, ':latest') then left({_NAME}, length({_NAME}) - 7) || ':v1' end
    as mirror_ref
from images
""")
def q_image_rewrite(spark, sf_dir):
    i = fixture(spark, sf_dir, "images")
    return i.select("pos", "image", T.image_dest("image", _REG, strict=False).alias("worker_ref"),
                    T.image_dest("image", _REG, strict=True).alias("mirror_ref"))


_MODEL = ("case when p_partkey % 3 = 0 then p_name || '.v' || cast(p_size as varchar) "
          "else replace(p_brand, '#', '') || '/' || p_name || '.v' || cast(p_size as varchar) end")


@query("q_model_slug", ops="G28", oracle=f"""
select p_partkey, model,
  replace(lower(case when len(string_split(model, '/')) > 1 then string_split(model, '/')[2]
                     else string_split(model, '/')[1] end), '.', '-') as slug
from (select p_partkey, {_MODEL} as model from part) x
""")
def q_model_slug(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    model = F.expr(_MODEL.replace("as varchar", "as string"))
    return p.select("p_partkey", model.alias("model")).select("p_partkey", "model", T.model_slug("model").alias("slug"))


_URI = "regexp_replace(url, '^https?://', 's3://')"


@query("q_uri_split", ops="G29", oracle=f"""
select page_id, uri, regexp_extract(uri, '^s3://([^/?#]*)', 1) as bucket,
  regexp_replace(regexp_extract(uri, '^s3://[^/?#]*([^?#]*)', 1), '^/+', '') as key,
  regexp_replace(uri, '/[^/]*$', '') as parent
from (select page_id, {_URI} as uri from pages) x
""")
def q_uri_split(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^https?://", "s3://").alias("uri"))
    return p.select("page_id", "uri", T.s3_parts("uri").alias("s")).select("page_id", "uri", "s.bucket", "s.key", "s.parent")


_CMD = ("'python -m run --dataset ' || lang || ' --model-api-key ' || source || '-' || cast(doc_id as varchar) "
        "|| ' --run-id r1' || case when doc_id % 2 = 0 then ' --model-api-key k' || cast(doc_id as varchar) else '' end")


@query("q_redact", ops="G35", oracle=f"""
select doc_id, regexp_replace({_CMD}, '(--model-api-key )[^ ]+', '\\1***REDACTED***', 'g') as display_cmd
from documents
""")
def q_redact(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    cmd = F.expr(_CMD.replace("as varchar", "as string"))
    return d.select("doc_id", T.redact_api_key(cmd).alias("display_cmd"))


def _snippet_sql() -> str:
    lines = D.split_lines("text")
    ln = "(case when doc_id % 7 = 0 then null else cast(doc_id % 7 as integer) end)"
    start = f"greatest({ln} - 2, 1)"
    end = f"least(len({lines}), {ln} + 1)"
    return f"""
case when {ln} is not null and {ln} >= 1 and {ln} <= len({lines}) then
  array_to_string(list_transform(range({start}, {end} + 1),
    lambda n: '    ' || case when n = {ln} then '-->' else '   ' end || ' ' || lpad(cast(n as varchar), 4, ' ')
         || '   ' || {lines}[n]), chr(10)) end"""


@query("q_snippet", ops="G10", oracle=f"""
select doc_id, {_snippet_sql()} as snippet from documents
""")
def q_snippet(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ln = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise((F.col("doc_id") % 7).cast("int"))
    return d.select("doc_id", T.snippet("text", ln).alias("snippet"))


# ------------------------------------------------------------- nested records
@query("q_train_record", ops="H4, G23", views=("tasks",), oracle=f"""
select instance_id, {D.lit(T.TASK_PROMPT)} || problem_statement as input,
  cast(to_json(struct_pack(instance_id := instance_id, pos := pos, repo := repo,
                      problem_statement := problem_statement, split := split)) as varchar) as label
from tasks
""")
def q_train_record(spark, sf_dir):
    t = fixture(spark, sf_dir, "tasks")
    return t.select("instance_id", T.task_prompt(F.col("problem_statement")).alias("input"),
                    F.to_json(F.struct("instance_id", "pos", "repo", "problem_statement", "split")).alias("label"))


_LABEL = ("case when event_id % 3 = 0 then '{\"instance_id\": \"inst__' || cast(user_id as varchar) || '\"}' "
          "when event_id % 3 = 1 then props else 'not json' end")


@query("q_label_parse", ops="H5", oracle=f"""
select event_id, coalesce(case when json_valid(lbl) then json_extract_string(lbl, '$.instance_id') end, 'unknown')
  as instance_id
from (select event_id, {_LABEL} as lbl from events) x
""")
def q_label_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lbl = F.expr(_LABEL.replace("as varchar", "as string"))
    parsed = F.from_json(lbl, "instance_id string")
    return e.select("event_id", F.coalesce(parsed["instance_id"], F.lit("unknown")).alias("instance_id"))


@query("q_label_variant", ops="H5, H4, G12", oracle="""
select event_id, case when event_id % 4 = 0 then 'inst__' || user_id when event_id % 4 = 1 then 'user-' || user_id
    when event_id % 4 = 2 and event_id % 3 = 0 then 'map-' || event_id else 'unknown' end as instance_id,
  case when event_id % 4 = 1 then cast(event_id as bigint) end as pos,
  case when event_id % 4 = 3 then null when event_id % 4 = 2 and event_id % 3 > 0 then 'other'
       when event_id % 4 = 1 then 'instance_id, pos' else 'instance_id' end as fields
from events
""")
def q_label_variant(spark, sf_dir):
    """Labels that come as JSON text, structs, maps and broken text, in one
    VARIANT column."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    nth = F.col("event_id") % 4
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    text = e.where(nth == 0).select("event_id", F.concat(F.lit('{"instance_id": "inst__'), user, F.lit('"}')).alias("label"))
    struct = e.where(nth == 1).select("event_id", F.struct(F.concat(F.lit("user-"), user).alias("instance_id"),
                                                          F.col("event_id").cast("bigint").alias("pos")).alias("label"))
    key = F.when(F.col("event_id") % 3 == 0, F.lit("instance_id")).otherwise(F.lit("other"))
    maps = e.where(nth == 2).select("event_id", F.create_map(key, F.concat(F.lit("map-"), event)).alias("label"))
    broken = e.where(nth == 3).select("event_id", F.lit("not json").alias("label"))
    rows = V.union_labels(text, struct, maps, broken)
    label = F.col("label")
    return rows.select("event_id", V.label_id(label).alias("instance_id"), V.label_field(label, "pos", "bigint").alias("pos"),
                       F.array_join(F.array_sort(F.map_keys(V.label_object(label))), ", ").alias("fields"))


@query("q_label_fields", ops="H4, H5", views=("tasks",), oracle="""
select unnest(['instance_id', 'pos', 'repo', 'problem_statement', 'split']) as field,
  unnest(['STRING', 'BIGINT', 'STRING', 'STRING', 'STRING']) as type,
  unnest([count(instance_id), count(pos), count(repo), count(problem_statement), count(split)]) as n
from tasks
""")
def q_label_fields(spark, sf_dir):
    """Which fields the written training labels (H4) have, and their types."""
    record = F.to_json(F.struct("instance_id", "pos", "repo", "problem_statement", "split"))
    labels = fixture(spark, sf_dir, "tasks").select(record.alias("label"))
    return V.label_fields(labels.select(V.as_label(labels, "label").alias("label")))
