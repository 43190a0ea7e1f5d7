"""Patch queries: E8, G7-G9, G19, G34, B7, D12, D19, I2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patch as P
from ..operators import patches as OP
from ..sources.fixtures import fixture
from . import duck as D
from .registry import query

_LINES = D.split_lines("patch")
_HUNK = r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"

_DIFF_LINES_SQL = f"""
l as (
  select instance_id, unnest(range(len(arr))) as pos, unnest(arr) as line
  from (select instance_id, {_LINES} as arr from patches where patch is not null and patch <> '') x),
g as (
  select *, sum(case when starts_with(line, '@@') then 1 else 0 end)
    over (partition by instance_id order by pos rows between unbounded preceding and current row) as seg,
    lag(line) over (partition by instance_id order by pos) as before
  from l),
n as (
  select *, first_value(coalesce(try_cast(nullif(regexp_extract(line, {D.lit(_HUNK)}, 1), '') as integer), 1)) over s as olen,
    first_value(coalesce(try_cast(nullif(regexp_extract(line, {D.lit(_HUNK)}, 3), '') as integer), 1)) over s as nlen,
    coalesce(sum(case when line = '' or line[1] in ('-', ' ') then 1 else 0 end) over p, 0) as oldn,
    coalesce(sum(case when line = '' or line[1] in ('+', ' ') then 1 else 0 end) over p, 0) as newn
  from g window s as (partition by instance_id, seg order by pos),
    p as (partition by instance_id, seg order by pos rows between unbounded preceding and 1 preceding)),
k as (
  select *, case when starts_with(line, 'diff --git ') then 'git'
    when starts_with(line, '+++ ') and coalesce(starts_with(before, '--- '), false)
      and not (seg > 0 and oldn - 1 < olen and newn < nlen) then 'header'
    when starts_with(line, '@@') then 'hunk'
    when starts_with(line, '+') then '+'
    when starts_with(line, ' ') then ' '
    when line = '' then ''
    when starts_with(line, '-') then '-'
    when starts_with(line, chr(92)) then chr(92)
    else 'other' end as kind
  from n),
f as (
  select *, last_value(case when kind = 'header' then
      (case when starts_with(substring(line, 5), 'b/') then substring(line, 7) else substring(line, 5) end)
      when kind in ('git', 'other') then '' end ignore nulls)
    over (partition by instance_id order by pos rows between unbounded preceding and current row) as file
  from k),
h as (
  select *,
    last_value(case when kind = 'hunk' and coalesce(file <> '', false) then pos
                    when kind in ('header', 'git', 'other') then -1 end ignore nulls)
      over (partition by instance_id order by pos rows between unbounded preceding and current row) as hp,
    sum(case when kind in ('+', ' ', '') then 1 else 0 end)
      over (partition by instance_id order by pos rows between unbounded preceding and current row) as cnt
  from f),
s as (
  select *,
    last_value(case when kind = 'hunk' and coalesce(file <> '', false)
                    then coalesce(try_cast(regexp_extract(line, {D.lit(_HUNK)}, 2) as integer), 1) end ignore nulls)
      over (partition by instance_id order by pos rows between unbounded preceding and current row) as h_start,
    last_value(case when kind = 'hunk' and coalesce(file <> '', false) then cnt end ignore nulls)
      over (partition by instance_id order by pos rows between unbounded preceding and current row) as h_cnt
  from h),
dl as (
  select instance_id, cast(pos as bigint) as pos, kind,
    case when coalesce(file <> '', false) then file end as file,
    case when coalesce(hp >= 0, false) then cast(hp as bigint) end as hunk_pos,
    case when coalesce(hp >= 0, false) and kind in ('+', ' ', '') then cast(h_start + cnt - h_cnt - 1 as bigint) end
      as new_lineno,
    case when kind in ('+', ' ') then substring(line, 2) else line end as text
  from s)
"""


def _lines(spark, sf_dir):
    return OP.diff_lines(fixture(spark, sf_dir, "patches"))


@query("q_diff_lines", ops="E8, G8", views=("patches",), oracle=f"""
, {_DIFF_LINES_SQL}
select * from dl
""")
def q_diff_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select(
        "instance_id", F.col("pos").cast("bigint").alias("pos"), "kind", "file",
        F.col("hunk_pos").cast("bigint").alias("hunk_pos"), F.col("new_lineno").cast("bigint").alias("new_lineno"),
        "text")


_PER_FILE_SQL = f"""
, {_DIFF_LINES_SQL}
select instance_id, file, count(*) filter (where kind = '+') as added, count(*) filter (where kind = '-') as removed,
  max(new_lineno) as last_line
from dl where file is not null group by instance_id, file
"""
_PER_FILE = "file, count_if(kind = '+') as added, count_if(kind = '-') as removed, max(new_lineno) as last_line"


@query("q_table_lines", ops="E8, G9, I1", views=("patches",), oracle=_PER_FILE_SQL)
def q_table_lines(spark, sf_dir):
    """The Arrow table function in SQL: lines added and removed per file."""
    OP.register_functions(spark)
    return spark.sql(f"""
        select key as instance_id, {_PER_FILE} from patch_lines(table(select instance_id, patch from {{patches}}))
        where file is not null group by key, file""", patches=fixture(spark, sf_dir, "patches"))


@query("q_lateral_lines", ops="E8, I1", views=("patches",), oracle=_PER_FILE_SQL)
def q_lateral_lines(spark, sf_dir):
    """The same by a lateral join with the function of one patch."""
    OP.register_functions(spark)
    return spark.sql(f"""
        select instance_id, {_PER_FILE} from {{patches}} p, lateral patch_lines_of(p.patch) l
        where file is not null group by instance_id, file""", patches=fixture(spark, sf_dir, "patches"))


@query("q_hunk_text", ops="G9, E8", views=("patches",), oracle=f"""
, {_DIFF_LINES_SQL}
select instance_id, file, hunk_pos, min(new_lineno) as new_start, count(*) as n_lines,
  string_agg(text, chr(10) order by pos) as fragment
from dl where hunk_pos is not null and kind in ('+', ' ', '')
group by instance_id, file, hunk_pos
""")
def q_hunk_text(spark, sf_dir):
    f = OP.hunk_fragments(fixture(spark, sf_dir, "patches"))
    return f.select("instance_id", "file", F.col("hunk_pos").cast("bigint").alias("hunk_pos"),
                    F.col("new_start").cast("bigint").alias("new_start"),
                    F.col("n_lines").cast("bigint").alias("n_lines"), "fragment")


_FILES = (f"list_filter(list_transform(list_filter({_LINES}, lambda l: starts_with(l, '+++ ')), "
          f"lambda l: case when starts_with(substring(l, 5), 'b/') then substring(l, 7) else substring(l, 5) end), "
          f"lambda p: p <> '/dev/null')")


@query("q_changed_files", ops="G7", views=("patches",), oracle=f"""
select instance_id, cast(len({_FILES}) as bigint) as n_files, array_to_string({_FILES}, ',') as files
from patches
""")
def q_changed_files(spark, sf_dir):
    p = fixture(spark, sf_dir, "patches")
    files = P.changed_files(F.col("patch"))
    return p.select("instance_id", F.size(files).cast("bigint").alias("n_files"),
                    F.array_join(files, ",").alias("files"))


_PY = f"list_filter({_FILES}, lambda f: ends_with(f, '.py'))"


@query("q_py_files", ops="B7", views=("patches",), oracle=f"""
select instance_id, cast(len({_PY}) as bigint) as n_py,
  case when len({_PY}) = 0 then 'skipped' else 'check' end as status,
  case when len({_PY}) = 0 then cast(1.0 as double) end as score
from patches
""")
def q_py_files(spark, sf_dir):
    p = fixture(spark, sf_dir, "patches")
    py = P.python_files(P.changed_files(F.col("patch")))
    none = F.size(py) == 0
    return p.select("instance_id", F.size(py).cast("bigint").alias("n_py"),
                    F.when(none, F.lit("skipped")).otherwise(F.lit("check")).alias("status"),
                    F.when(none, F.lit(1.0)).alias("score"))


_SP = D.strip("patch")
_GITS = f"list_filter({D.split_lines(_SP)}, lambda l: starts_with(l, 'diff --git '))"


@query("q_patch_stats", ops="D19", views=("patches",), oracle=f"""
select instance_id,
  cast(coalesce(length({_SP}) - length(replace({_SP}, chr(10), '')), 0) as bigint) as patch_lines,
  cast(coalesce(len(list_distinct(list_filter(list_transform({_GITS},
    lambda l: case when strpos(l, ' b/') > 0 then substring(l, strpos(l, ' b/') + 3) end), lambda x: x is not null))), 0)
    as bigint) as files_changed
from patches
""")
def q_patch_stats(spark, sf_dir):
    return OP.patch_stats(fixture(spark, sf_dir, "patches"))


@query("q_patch_b64", ops="G34", views=("patches",), oracle="""
select instance_id, to_base64(encode(case when ends_with(patch, chr(10)) then patch else patch || chr(10) end)) as b64
from patches where patch <> ''
""")
def q_patch_b64(spark, sf_dir):
    p = fixture(spark, sf_dir, "patches").filter(F.col("patch") != "")
    return p.select("instance_id", P.patch_b64("patch").alias("b64"))


# The oracle knows the hunks the view plants: 'def f(:' and the unclosed 'w = ('
# do not parse, everything else does, and the other sections are not Python.
_PLANTED = """
p as (
  select instance_id, patch, patch <> '' as py, contains(patch, '+def f(:') as bad1, contains(patch, ' w = (') as bad2,
    regexp_extract(patch, 'pkg/a[0-9]') || '.py' as file, regexp_extract(patch, 'z = ([0-9]+)', 1) as num
  from patches)
"""


@query("q_syntax_score", ops="D12, I2, B7, E8, G9", views=("patches",), oracle=f"""
, {_PLANTED}
select instance_id, case when py then 'ok' else 'skipped' end as status,
  cast(case when bad1 or bad2 then 0.0 else 1.0 end as double) as score, cast(py as bigint) as files_total,
  cast(py and not (bad1 or bad2) as bigint) as files_parsed, cast(bad1 or bad2 as bigint) as files_errored,
  cast(0 as bigint) as files_skipped
from p
""")
def q_syntax_score(spark, sf_dir):
    return OP.syntax_scores(fixture(spark, sf_dir, "patches"))


@query("q_syntax_feedback", ops="G19, I2", views=("patches",), oracle=f"""
, {_PLANTED}
select instance_id, case when py then 'ok' else 'skipped' end as status,
  cast(case when bad1 or bad2 then 0.0 else 1.0 end as double) as score,
  case when not py then '[ast_check] SKIPPED' when not (bad1 or bad2) then '[ast_check] PASSED: no syntax errors detected'
  else '[ast_check] FAILED: syntax errors in the following files:'
    || case when bad1 then chr(10) || '  - ' || file || ': line 2, offset 7: invalid syntax' || chr(10)
         || '           1   x = 1' || chr(10) || '    -->    2 + def f(:' else '' end
    || case when bad2 then chr(10) || '  - ' || file || ': line 22, offset 5: ''('' was never closed' || chr(10)
         || '          20   z = ' || num || chr(10) || '          21 + ++ z' || chr(10) || '    -->   22   w = (' else '' end
  end as feedback
from p
""")
def q_syntax_feedback(spark, sf_dir):
    return OP.syntax_feedback(fixture(spark, sf_dir, "patches"))


@query("q_context", ops="H6, G7", views=("patches", "tasks"), oracle=f"""
select p.instance_id, p.patch, cast(len({_FILES}) as bigint) as n_changed,
  array_to_string({_FILES}, ',') as changed_files, t.instance_id as task_id,
  cast(to_json(struct_pack(repo := t.repo, split := t.split)) as varchar) as metadata
from patches p join tasks t on t.instance_id = p.instance_id
""")
def q_context(spark, sf_dir):
    p = fixture(spark, sf_dir, "patches")
    t = fixture(spark, sf_dir, "tasks").select("instance_id", "repo", "split")
    ctx = OP.patch_context(p, t)
    return ctx.select("instance_id", "ctx.patch", F.size("ctx.changed_files").cast("bigint").alias("n_changed"),
                      F.array_join("ctx.changed_files", ",").alias("changed_files"), "ctx.task_id",
                      "ctx.metadata")
