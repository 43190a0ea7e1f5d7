"""Derived views with the shape of recorded run data.

The driver's tables are TPC-H-like; these views reshape them into the records
the operators consume (tasks, prompts, graded instances, verifier results,
turns, agent steps, ...).  Each view is one SQL text that runs unchanged on
Spark and on DuckDB, so the Spark plan and the oracle start from identical
inputs.  On Spark the base tables are registered as temp views named per data
folder and the view SQL is analysed immediately, so the returned DataFrame is
bound to the files of the ``sf_dir`` it was built for.  Two views (``steps``, ``turn_runs``) number
rows per user / conversation; on Spark they are built with an associative
scan instead of ``row_number`` so a hot key is not numbered by one task
(``BUILDERS``); the oracle keeps the SQL, and both give the same rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# name -> (base tables, SQL text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "tasks": (("documents",), """
select concat('inst__', cast(doc_id as string)) as instance_id, doc_id as pos, source as repo,
  text as problem_statement, case when doc_id % 5 = 0 then 'dev' else 'test' end as split
from documents
"""),
    "prompts": (("documents",), """
select concat('inst__', cast(doc_id as string)) as instance_id, doc_id as pos,
  case when doc_id % 17 = 0 then '' else concat('You fix bugs.', chr(10), text) end as text_inputs
from documents where doc_id % 4 <> 0
union all
select concat('inst__', cast(doc_id as string)) as instance_id, doc_id + 1000000 as pos, 'one line only' as text_inputs
from documents where doc_id % 8 = 1
"""),
    "instance_results": (("orders",), """
select concat('inst__', cast(o_orderkey as string)) as instance_id,
  case when o_orderkey % 13 = 0 then 'job_failed' when o_orderkey % 17 = 0 then '' else null end as error,
  (o_orderkey % 10 <> 0) as patch_exists,
  case when o_orderkey % 19 = 0 then null else o_orderstatus = 'F' end as resolved
from orders
"""),
    "verifier_results": (("labels",), """
select doc_id as instance_id, 'ast_check' as name,
  case when doc_id % 11 = 0 then 'error' when doc_id % 7 = 0 then 'skipped' else 'ok' end as status,
  cast(quality as double) as score, cast(1.0 as double) as pass_threshold, cast(doc_id % 90 as double) as wall_clock_seconds
from labels
union all
select doc_id as instance_id, 'swe_test' as name, case when doc_id % 13 = 0 then 'timeout' else 'ok' end as status,
  cast(1.0 - toxic * 0.5 as double) as score, cast(0.5 as double) as pass_threshold, cast(doc_id % 70 as double) as wall_clock_seconds
from labels
"""),
    # results in the order of recording, some recorded again, with what the verifiers noted
    "recorded_results": (("labels",), """
select doc_id as instance_id, 'ast_check' as name, cast(0 as int) as pos,
  case when doc_id % 11 = 0 then 'error' when doc_id % 7 = 0 then 'skipped' else 'ok' end as status,
  cast(quality as double) as score, cast(1.0 as double) as pass_threshold,
  case when quality = 1 then '{}' else concat('{"errors":[{"file":"pkg/a', cast(doc_id as string), '.py","line":',
    cast(doc_id % 4 as string), ',"offset":3,"message":"invalid syntax"}]}') end as details
from labels
union all
select doc_id as instance_id, 'swe_test' as name, cast(0 as int) as pos,
  case when doc_id % 13 = 0 then 'timeout' else 'ok' end as status,
  case when toxic = 1 then cast(0.295 as double) else cast(1.0 as double) end as score, cast(0.5 as double) as pass_threshold,
  case when doc_id % 13 = 0 then (case when doc_id % 2 = 0 then '{"error":"no answer in time"}' else '{}' end)
    when doc_id % 2 = 0 then '{"patch_successfully_applied":true,"tests_status":{"z":"FAILED","m":"PASSED","a":"ERROR"}}'
    else '{"patch_successfully_applied":false}' end as details
from labels
union all
select doc_id as instance_id, 'ast_check' as name, cast(1 as int) as pos, 'error' as status, cast(0.0 as double) as score,
  cast(1.0 as double) as pass_threshold, '{}' as details
from labels where doc_id % 5 = 0
union all
select doc_id as instance_id, 'swe_test' as name, cast(1 as int) as pos, 'error' as status, cast(0.0 as double) as score,
  cast(0.5 as double) as pass_threshold, '{}' as details
from labels where doc_id % 3 = 0
"""),
    # results with what the safe wrapper noted on errors
    "noted_results": (("labels",), """
select doc_id as instance_id, case when doc_id % 2 = 0 then 'ast_check' else 'swe_test' end as name,
  case when doc_id % 5 = 0 then 'error' when doc_id % 7 = 0 then 'skipped' else 'ok' end as status,
  cast(quality as double) as score, cast(1.0 as double) as pass_threshold, cast(doc_id % 130 as double) as wall_clock_seconds,
  case when doc_id % 15 = 0 then '{}' when doc_id % 5 = 0 then concat('{"error":"cannot read ', cast(doc_id as string),
    '","error_type":"', case when doc_id % 10 = 0 then 'OSError' else 'ValueError' end, '"}') else '{"n":1}' end as details
from labels
"""),
    # programs that a check runs: some never end, some take all memory, some end the process
    "programs": (("documents",), """
select concat('inst__', cast(doc_id as string)) as instance_id, doc_id as pos, concat('import os', chr(10), 'def f():', chr(10), case
    when doc_id % 1999 = 7 then concat('    while True:', chr(10), '        pass')
    when doc_id % 251 = 9 then concat('    held = []', chr(10), '    while True:', chr(10), '        held.append(bytearray(1 << 25))')
    when doc_id % 127 = 5 then '    os._exit(3)'
    when doc_id % 113 = 4 then '    os.kill(os.getpid(), 11)'
    when doc_id % 11 = 3 then '    return [][0]'
    when doc_id % 7 = 2 then '    return -1'
    else concat('    return ', cast(length(text) as string)) end) as patch
from documents
"""),
    "verifier_config": ((), """
select * from (values
  (1, 'ast_check', 'static', true, false, cast(1.0 as double), cast(0.25 as double)),
  (2, 'swe_test', 'dynamic', true, true, cast(0.5 as double), cast(0.75 as double)))
as t(ord, name, mode, run_intermediate, run_final, pass_threshold, weight)
"""),
    "turn_runs": (("conversations",), """
select conv_id as instance_id, row_number() over (partition by conv_id order by turn) - 1 as turn,
  text as output, length(text) % 3 = 0 as all_passed, cast(length(text) % 5 as double) / 4 as aggregate_score
from conversations where role = 'assistant'
"""),
    "steps": (("events",), """
select user_id as episode, row_number() over (partition by user_id order by ts, event_id) as step, event_id, ts,
  case when event_type = 'purchase' then 'submit' else 'bash' end as action,
  case when event_type = 'error' then 1 else 0 end as exit_code, props as stdout
from events
"""),
    "rollouts": (("lineitem",), """
select l_orderkey as prompt_id, l_linenumber as sample,
  case when l_returnflag = 'R' then cast(1.0 as double) else cast(0.0 as double) end as reward
from lineitem
"""),
    "answers": (("lineitem",), """
select l_orderkey as prompt_id, l_linenumber as sample, concat('Q', cast(l_orderkey as string), ': ') as prompt,
  concat(case when l_orderkey % 6 = 0 then '' else concat('Q', cast(l_orderkey as string), ': ') end,
    case l_linenumber % 5
      when 0 then concat('so ', chr(92), 'boxed{ ', cast(cast(floor(l_quantity) as int) as string), ' }')
      when 1 then concat('thus #### 1,', lpad(cast(cast(floor(l_quantity) as int) as string), 3, '0'))
      when 2 then concat('it is ', cast(cast(floor(l_quantity) as int) as string), ' units')
      when 3 then concat('maybe ', cast(cast(floor(l_quantity) as int) as string), ', ok,')
      else 'no idea' end) as query,
  concat('work #### ', cast(cast(floor(l_quantity) as int) + (case when l_linenumber % 5 = 1 then 1000 else 0 end)
    + (case when l_suppkey % 3 = 0 then 1 else 0 end) as string)) as label
from lineitem
"""),
    "logs": (("documents",), """
select concat('inst__', cast(doc_id as string)) as instance_id,
  concat('boot', chr(10), case doc_id % 6
    when 0 then text
    when 1 then concat('<<PATCH_START_7829361>>', chr(10), text, chr(10), '<<PATCH_END_7829361>>')
    when 2 then concat('<<PREDS_JSON_START_7829361>>', chr(10), '{"inst__', cast(doc_id as string), '": {"instance_id": "inst__', cast(doc_id as string), '", "model_patch": "p', cast(doc_id as string), '"}}', chr(10), '<<PREDS_JSON_END_7829361>>')
    when 3 then concat('<<PREDS_JSON_START_7829361>>', '{"other": {"model_patch": "q"}}', '<<PREDS_JSON_END_7829361>>')
    when 4 then concat('<<PATCH_END_7829361>>', text, '<<PATCH_START_7829361>>')
    else concat('<<PREDS_JSON_START_7829361>>', 'not json', '<<PREDS_JSON_END_7829361>>') end,
    chr(10), case when doc_id % 4 = 0 then '>>>>> Patch Apply Failed' else '>>>>> Applied Patch' end) as logs
from documents
"""),
    "patches": (("orders",), """
select concat('inst__', cast(o_orderkey as string)) as instance_id,
  case when o_orderkey % 10 = 0 then '' else concat(
    'diff --git a/pkg/a', cast(o_orderkey % 5 as string), '.py b/pkg/a', cast(o_orderkey % 5 as string), '.py', chr(10),
    '--- a/pkg/a', cast(o_orderkey % 5 as string), '.py', chr(10), '+++ b/pkg/a', cast(o_orderkey % 5 as string), '.py', chr(10),
    '@@ -1,2 +1,2 @@', chr(10), ' x = 1', chr(10), '-y = 1', chr(10),
    case when o_orderkey % 7 = 0 then '+def f(:' else '+y = 2' end,
    case when o_orderkey % 2 = 0 then concat(chr(10), '@@ -20,3 +20,3 @@ def g', chr(10), ' z = ', cast(o_orderkey as string), chr(10),
      '--- gone', chr(10), '+++ z', chr(10), case when o_orderkey % 11 = 0 then ' w = (' else ' w = 1' end) else '' end,
    case when o_orderkey % 3 = 0 then concat(chr(10), 'diff --git a/doc.md b/doc.md', chr(10), '--- a/doc.md', chr(10),
      '+++ b/doc.md', chr(10), '@@ -5 +5,2 @@', chr(10), ' intro', chr(10), '+', o_orderpriority) else '' end) end as patch
from orders
"""),
    "tests": (("events",), """
select cast(floor(event_id / 4) as bigint) as instance_id, concat('t', cast(event_id % 4 as string)) as test,
  case when event_id % 4 = 0 then 'FAIL_TO_PASS' else 'PASS_TO_PASS' end as kind,
  case when event_id % 11 = 0 then null when event_type = 'error' then 'FAILED'
       when event_type = 'signup' and event_id % 6 = 0 then 'ERROR' else 'PASSED' end as status
from events
"""),
    # suites of up to 50 tests in the order of recording, some recorded twice
    "suite_tests": (("events",), """
select cast(floor(event_id / 64) as bigint) as instance_id, concat('t', cast((event_id * 7) % 50 as string)) as test,
  event_id as pos, case when event_id % 13 = 0 then null when event_id % 11 = 0 then 'ERROR'
    when event_id % 3 <> 0 then 'FAILED' else 'PASSED' end as status
from events
"""),
    "test_runs": (("events",), """
select cast(floor(event_id / 64) as bigint) as instance_id,
  case when event_id % 448 = 0 then 'error' when event_id % 704 = 0 then 'timeout' else 'ok' end as status,
  case when event_id % 256 = 0 then cast(1.0 as double) else cast(0.0 as double) end as score,
  case when event_id % 896 = 0 then null else 'job_failed' end as error, event_id % 320 <> 0 as applied,
  case when event_id % 192 = 0 then '' when event_id % 192 = 64 then concat('line1', chr(10), 'line', cast(event_id as string))
    else repeat(concat('log ', cast(event_id as string), chr(10)), 700) end as stdout
from events where event_id % 64 = 0
"""),
    # the unit-test result of a run's final verification, where there is one
    "final_results": (("conversations",), """
select distinct conv_id as instance_id, conv_id % 3 = 0 as resolved from conversations where conv_id % 5 <> 0
"""),
    "jobs": (("orders",), """
select concat('inst__', cast(o_orderkey as string)) as instance_id,
  case when o_orderstatus = 'F' then 1 else 0 end as succeeded, case when o_orderstatus = 'F' then 0 else 1 end as failed,
  case when o_orderstatus = 'P' and o_orderkey % 2 = 0 then 'DeadlineExceeded'
       when o_orderstatus <> 'F' then 'BackoffLimitExceeded' else null end as reason,
  case when o_orderkey % 9 = 0 then '' else o_orderpriority end as test_output
from orders
"""),
    "images": (("part",), """
select p_partkey as pos, case when p_partkey % 29 = 0 then null else concat('swebench/sweb.eval.x86_64.',
  lower(replace(p_brand, '#', '_')), '_1776_', cast(p_partkey % 40 as string),
  case when p_partkey % 23 = 0 then ':v9' else ':latest' end) end as image, p_partkey % 4 = 0 as mirrored
from part
"""),
    "code_samples": (("documents",), """
select concat('task/', cast(doc_id as string)) as task_id, 'f' as entry_point, case doc_id % 5
    when 0 then concat('Sure:', chr(10), '```python', chr(10), 'def f():', chr(10), '    return ', cast(doc_id as string), chr(10), '```', chr(10), 'done')
    when 1 then concat('```python', chr(10), 'def f(): return 1')
    when 2 then concat('  ', lang, ' plain  ')
    when 3 then concat('x <patch>', chr(10), '--- a/f', chr(10), '</patch> y')
    else concat('```diff', chr(10), '+++ b/f', chr(10), '```') end as response,
  case when doc_id % 3 = 0 then 'passed' when doc_id % 3 = 1 then 'timed out' else 'failed: boom' end as result
from documents
"""),
    "tool_texts": (("events",), """
select event_id, case event_id % 6
    when 0 then concat('go <bash> ls', chr(10), '-la </bash>') when 1 then 'done <submit />'
    when 2 then '<submit/> <bash>x</bash>' when 3 then '<bash>x</bash> <submit/>' when 4 then concat(' ', event_type, ' ')
    else '  ' end as action_text,
  concat('out ', event_type, case when event_id % 5 = 0 then '' else concat(' __RC_8372916__:', cast(event_id % 3 as string), chr(10), 'tail ') end) as raw_output
from events
"""),
    # --- views added by this repo (same single-dialect rule) -------------
    # function-completion problems: one per document, later copies of a
    # task id replace earlier ones (pos orders them)
    "problems": (("documents",), """
select concat('task/', cast(doc_id as string)) as task_id, doc_id as pos,
  concat('def f():', chr(10), '    ', chr(34), chr(34), chr(34), lang, chr(34), chr(34), chr(34), chr(10)) as prompt,
  concat('def check(candidate):', chr(10), '    assert candidate() is not None') as test, 'f' as entry_point
from documents
"""),
    # recorded rollout attempts (three per rollout); an infrastructure error
    # makes an attempt unusable
    "attempts": (("events",), """
select cast(floor(event_id / 3) as bigint) as rollout_id, cast(event_id % 3 + 1 as int) as attempt,
  (event_type = 'error' or event_type = 'signup') as infra_error, value as reward
from events
"""),
    # patch-apply attempts: every line item is one recorded attempt of an
    # order's patch; its line number picks the method in the fixed order
    # (1 git apply, 2 git apply --reject, 3 patch --fuzz), repeating
    "apply_attempts": (("lineitem",), """
select concat('inst__', cast(l_orderkey as string)) as instance_id, (l_linenumber - 1) % 3 + 1 as ord,
  case (l_linenumber - 1) % 3 when 0 then 'git apply --verbose' when 1 then 'git apply --verbose --reject'
       else 'patch --batch --fuzz=5 -p1 -i' end as method,
  (l_returnflag = 'R' or l_linestatus = 'O') as ok
from lineitem
"""),
}


def view_sql(name: str) -> str:
    return VIEWS[name][1].strip()




def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``steps`` with the step number from an associative scan instead of
    ``row_number`` over the whole user: a user holding a third of all events,
    even on one day, is numbered by many tasks.  Same rows as the view's
    SQL."""
    from ..operators.machines import NUMBERING, scan
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    numbered = scan(ev, ["user_id"], ["ts", "event_id"], NUMBERING)
    return numbered.select(
        F.col("user_id").alias("episode"), F.col("n").cast("int").alias("step"), "event_id", "ts",
        F.when(F.col("event_type") == "purchase", F.lit("submit")).otherwise(F.lit("bash")).alias("action"),
        F.when(F.col("event_type") == "error", F.lit(1)).otherwise(F.lit(0)).alias("exit_code"),
        F.col("props").alias("stdout"))


def _turn_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``turn_runs`` with the turn number from an associative scan over the
    assistant messages of a conversation.  Same rows as the view's SQL."""
    from ..operators.machines import NUMBERING, scan
    c = (table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
         .select("conv_id", "turn", "text"))
    numbered = scan(c, ["conv_id"], ["turn"], NUMBERING)
    n = F.length("text")
    return numbered.select(
        F.col("conv_id").alias("instance_id"), (F.col("n") - 1).cast("int").alias("turn"),
        F.col("text").alias("output"), (n % 3 == 0).alias("all_passed"),
        ((n % 5).cast("double") / 4).alias("aggregate_score"))


# Spark-side builders that replace a view's SQL with a scale-safe plan
# producing the same rows (the oracle keeps the SQL text).
BUILDERS = {"steps": _steps, "turn_runs": _turn_runs}


def _view_names(sf_dir: str, tables) -> dict[str, str]:
    """Temp-view names private to one data folder, so queries over
    different folders in one session never see each other's tables."""
    tag = hashlib.md5(sf_dir.rstrip("/").encode()).hexdigest()[:10]
    return {t: f"{t}__{tag}" for t in tables}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build the derived view ``name`` from the tables under ``sf_dir``."""
    if name in BUILDERS:
        return BUILDERS[name](spark, sf_dir)
    names = _view_names(sf_dir, VIEWS[name][0])
    for t, v in names.items():
        table(spark, sf_dir, t).createOrReplaceTempView(v)
    sql = re.sub(r"(?i)\bfrom\s+(\w+)", lambda m: "from " + names.get(m.group(1), m.group(1)), view_sql(name))
    return spark.sql(sql)


def fixtures(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [fixture(spark, sf_dir, n) for n in names]


def oracle_with(*names: str) -> str:
    """``WITH`` clause that inlines the views for the DuckDB oracle."""
    ctes = ",\n".join(f"{n} AS (\n{view_sql(n)}\n)" for n in names)
    return f"WITH {ctes}\n"
