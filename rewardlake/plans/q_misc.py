"""Image, job and test-result queries: B12, B14, C9, D14-D16, E9-E11, G20, G36."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images as IM
from ..operators import jobs as JB
from ..operators import sequence as SQ
from ..sources.fixtures import fixture
from ..sources.tables import table
from .registry import query

REGISTRY_PREFIX = "registry.local:5000/agents"
_NAME = "(case when strpos(image, '/') > 0 then substring(image, strpos(image, '/') + 1) else image end)"
_DEST = (f"(case when ends_with({_NAME}, ':latest') then '{REGISTRY_PREFIX}/' || left({_NAME}, length({_NAME}) - 7)"
         f" || ':v1' end)")
_NOTAG = f"regexp_replace({_NAME}, ':[^:]*$', '')"
_REPO = (f"(case when strpos({_NOTAG}, 'sweb.eval.x86_64.') > 0 "
         f"then substring({_NOTAG}, strpos({_NOTAG}, 'sweb.eval.x86_64.') + 17) else {_NOTAG} end)")
_COPY_SQL = "case when pos % 97 = 0 then 'rate_limit' when pos % 31 = 0 then 'error' else 'ok' end"


def _copy_result():
    p = F.col("pos")
    return (F.when(p % 97 == 0, F.lit("rate_limit")).when(p % 31 == 0, F.lit("error"))
            .otherwise(F.lit("ok")))


@query("q_unique_images", ops="D14", views=("images",), oracle="""
select distinct image from images where image is not null
""")
def q_unique_images(spark, sf_dir):
    return IM.unique_images(fixture(spark, sf_dir, "images"))


@query("q_image_summary", ops="D14", views=("images",), oracle="""
select count(*) as instances, count(distinct image) as unique_images, count(*) filter (where image is null) as failed
from images
""")
def q_image_summary(spark, sf_dir):
    return IM.image_summary(fixture(spark, sf_dir, "images"))


@query("q_images_per_repo", ops="D15", views=("images",), oracle=f"""
select {_REPO} as repo, count(*) as images from (select distinct image from images where image is not null) u
group by 1
""")
def q_images_per_repo(spark, sf_dir):
    return IM.images_per_repo(fixture(spark, sf_dir, "images"))


@query("q_mirror_pending", ops="C9, G27", views=("images",), oracle=f"""
select distinct {_DEST} as dest from images where image is not null and {_DEST} is not null
except
select distinct {_DEST} from images where mirrored and image is not null and {_DEST} is not null
""")
def q_mirror_pending(spark, sf_dir):
    return IM.mirror_pending(fixture(spark, sf_dir, "images"), REGISTRY_PREFIX)


@query("q_mirror_tally", ops="D16, E9, D14", views=("images",), oracle=f"""
, lines as (
  select image, case when {_DEST} is null then 'bad_tag' when bool_or(mirrored) then 'skip'
                     else min({_COPY_SQL}) end as action
  from images where image is not null group by image),
stop as (select min(image) as s from lines where action = 'rate_limit'),
b as (select l.*, (st.s is null or l.image < st.s) as before from lines l, stop st)
select count(*) as total, count(*) filter (where before and action = 'ok') as pulled,
  count(*) filter (where before and action = 'skip') as skipped,
  count(*) filter (where before and action in ('bad_tag', 'error')) as failed,
  count(*) - count(*) filter (where before and action = 'ok') - count(*) filter (where before and action = 'skip')
    - count(*) filter (where before and action in ('bad_tag', 'error')) as remaining
from b
""")
def q_mirror_tally(spark, sf_dir):
    lines = IM.mirror_lines(fixture(spark, sf_dir, "images"), REGISTRY_PREFIX, _copy_result())
    return IM.mirror_tally(lines)


_STOP = "(event_type = 'error' and value >= 100)"


@query("q_prefix_until", ops="E9", oracle=f"""
with fs as (select user_id, min(struct_pack(a := ts, b := event_id)) as s from events where {_STOP} group by user_id),
j as (select e.*, fs.s, (fs.s is null or struct_pack(a := e.ts, b := e.event_id) < fs.s) as before
      from events e left join fs on fs.user_id = e.user_id)
select user_id, count(*) filter (where before and event_type <> 'error') as processed,
  count(*) filter (where before and event_type = 'error') as failed,
  bool_or(s is not null) as stopped,
  count(*) - count(*) filter (where before) as remaining
from j group by user_id
""")
def q_prefix_until(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    stop = (F.col("event_type") == "error") & (F.col("value") >= 100)
    return SQ.run_until_stop(e, "user_id", ["ts", "event_id"], stop, F.col("event_type") == "error")


@query("q_error_streak", ops="E10", oracle="""
with t as (
  select user_id, event_type = 'error' as f,
    sum(case when event_type = 'error' then 0 else 1 end)
      over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as island
  from events),
r as (select user_id, island, count(*) as n from t where f group by user_id, island)
select u.user_id, cast(coalesce(max(r.n), 0) as bigint) as max_streak, coalesce(max(r.n), 0) >= 10 as tripped
from (select distinct user_id from events) u left join r on r.user_id = u.user_id group by u.user_id
""")
def q_error_streak(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return SQ.breaker(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error", 10)


# last status of every test that ran, and where it was first recorded
_SUITE = """
s as (select instance_id, test, min(pos) as first_pos, arg_max(status, pos) as status
      from suite_tests where status is not null group by instance_id, test)
"""
_FAILING = "list(test order by first_pos) filter (where status in ('FAILED', 'ERROR'))"


@query("q_failing_tests", ops="G36", views=("suite_tests",), oracle=f"""
, {_SUITE}
select instance_id, test from s where status in ('FAILED', 'ERROR')
""")
def q_failing_tests(spark, sf_dir):
    m = JB.tests_status(fixture(spark, sf_dir, "suite_tests"))
    return m.select("instance_id", F.explode(JB.failing_tests(F.col("tests_status"))).alias("test"))


@query("q_failing_top", ops="E11, G36", views=("suite_tests",), oracle=f"""
, {_SUITE}
select instance_id, count(*) filter (where status in ('FAILED', 'ERROR')) as n_failing,
  coalesce(array_to_string(list_slice({_FAILING}, 1, 20), ','), '') as shown,
  cast(greatest(count(*) filter (where status in ('FAILED', 'ERROR')) - 20, 0) as bigint) as n_more
from s group by instance_id
""")
def q_failing_top(spark, sf_dir):
    return JB.failing_top(fixture(spark, sf_dir, "suite_tests"))


@query("q_test_feedback", ops="G20, G36, E11", views=("suite_tests", "test_runs"), oracle=f"""
, {_SUITE},
g as (select instance_id, {_FAILING} as failing from s group by instance_id),
j as (select r.*, coalesce(g.failing, []) as failing from test_runs r left join g on g.instance_id = r.instance_id)
select instance_id, case when status <> 'ok' then '[swe_test] ' || upper(status) || ': ' || coalesce(error, 'unknown error')
  when score >= 1.0 then '[swe_test] PASSED: issue resolved'
  when not applied then '[swe_test] FAILED (score: 0.00)' || chr(10) || '  The patch could not be applied to the repository.'
  else '[swe_test] FAILED (score: 0.00)' || case when len(failing) > 0 then
    chr(10) || '  Failing tests (' || cast(len(failing) as varchar) || '):' || chr(10)
    || array_to_string(list_transform(list_slice(failing, 1, 20), lambda t: '    - ' || t), chr(10))
    || case when len(failing) > 20 then chr(10) || '    ... and ' || cast(len(failing) - 20 as varchar) || ' more'
            else '' end
    else '' end || case when stdout = '' then ''
      when length(stdout) < 4000 then chr(10) || chr(10) || '  Test output:' || chr(10) || '  ' || replace(stdout, chr(10), chr(10) || '  ')
      else chr(10) || chr(10) || '  Test output (last 3000 chars):' || chr(10) || '  ' || replace(right(stdout, 3000), chr(10), chr(10) || '  ')
      end end as feedback
from j
""")
def q_test_feedback(spark, sf_dir):
    runs = fixture(spark, sf_dir, "test_runs")
    failing = JB.tests_status(fixture(spark, sf_dir, "suite_tests")) \
                .select("instance_id", JB.failing_tests(F.col("tests_status")).alias("failing"))
    fb = JB.test_feedback(F.col("status"), F.col("score"), F.lit(1.0), F.col("error"), F.col("applied"),
                          F.coalesce(F.col("failing"), F.array().cast("array<string>")), F.col("stdout"))
    return runs.join(failing, "instance_id", "left").select("instance_id", fb.alias("feedback"))


_JOB_SQL = """
select instance_id, succeeded > 0 as succeeded,
  (not coalesce(succeeded > 0, false)) and coalesce(failed > 0, false) and coalesce(reason = 'DeadlineExceeded', false)
    as timed_out, test_output
from jobs
"""


@query("q_job_outcome", ops="B12", views=("jobs",), oracle=f"""
select instance_id, succeeded, timed_out,
  case when timed_out then 'timed_out' when succeeded then null else 'job_failed' end as error, test_output
from ({_JOB_SQL}) j
""")
def q_job_outcome(spark, sf_dir):
    return JB.job_outcome(fixture(spark, sf_dir, "jobs"))


@query("q_test_outcome", ops="B14, B12", views=("jobs",), oracle=f"""
select instance_id,
  case when e <> '' or coalesce(test_output, '') = '' then 'error' else 'ok' end as status,
  cast(case when e <> '' or coalesce(test_output, '') = '' then 0.0
       when test_output in ('1-URGENT', '2-HIGH') then 1.0 else 0.0 end as double) as score,
  case when e <> '' then e when coalesce(test_output, '') = '' then
    (case when timed_out then 'K8s Job timed out' else 'No test output captured from pod logs' end) end as message
from (select *, coalesce(case when timed_out then 'timed_out' when succeeded then null else 'job_failed' end, '') as e
      from ({_JOB_SQL}) j) x
""")
def q_test_outcome(spark, sf_dir):
    o = JB.job_outcome(fixture(spark, sf_dir, "jobs"))
    # grading of a captured log: the run resolved the task when its output
    # reports one of the two top priorities
    return JB.test_outcome(o, F.col("test_output").isin("1-URGENT", "2-HIGH"))


@query("q_graded_outcome", ops="B14", views=("jobs",), oracle=f"""
select instance_id, case when e <> '' or coalesce(test_output, '') = '' or g is not null then 'error' else 'ok' end as status,
  cast(case when e <> '' or coalesce(test_output, '') = '' or g is not null then 0.0
       when test_output in ('1-URGENT', '2-HIGH') then 1.0 else 0.0 end as double) as score,
  case when e <> '' then e when coalesce(test_output, '') = '' then
    (case when timed_out then 'K8s Job timed out' else 'No test output captured from pod logs' end) else g end as message
from (select *, coalesce(case when timed_out then 'timed_out' when succeeded then null else 'job_failed' end, '') as e,
        case when test_output = '3-MEDIUM' then 'no report for 3-MEDIUM' end as g
      from ({_JOB_SQL}) j) x
""")
def q_graded_outcome(spark, sf_dir):
    o = JB.job_outcome(fixture(spark, sf_dir, "jobs"))
    log = F.col("test_output")
    # logs of this kind hold no report, so grading them fails
    failed = F.when(log == "3-MEDIUM", F.concat(F.lit("no report for "), log))
    return JB.test_outcome(o, log.isin("1-URGENT", "2-HIGH"), failed)
