"""File sources (A2, A3, A6, A10) read back from files that Spark writes from
the tables, and the verifier extension point run on them (B10, B13, B15, D4,
F2, F3, I1)."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import scoring as S
from ..operators import verifier as V
from ..shipping import ship_by_value
from ..sources import files as FS
from ..sources import listing as LS
from ..sources import store as ST
from ..sources.fixtures import fixture
from ..sources.tables import table
from ..streaming.runner import new_area, run_append
from .q_joins import _PROMPTS_LOADED
from .registry import query

ship_by_value(__name__)

#: problems of one list file
LISTED = 256


@query("q_read_problems", ops="A2", oracle="""
select concat('task/', doc_id) as task_id, text as prompt, lang as test, 'f' as entry_point from documents
""")
def q_read_problems(spark, sf_dir):
    """Problem files that hold one JSON list each."""
    d, path = table(spark, sf_dir, "documents"), new_area(spark, "problems")
    problem = F.to_json(F.struct(F.concat(F.lit("task/"), F.col("doc_id").cast("string")).alias("task_id"),
                                 F.col("text").alias("prompt"), F.col("lang").alias("test"), F.lit("f").alias("entry_point")))
    lists = (d.select(F.expr(f"doc_id div {LISTED}").alias("part"), problem.alias("p")).groupBy("part")
             .agg(F.concat(F.lit("["), F.array_join(F.collect_list("p"), ","), F.lit("]")).alias("value")))
    lists.write.partitionBy("part").text(path)
    return FS.read_json_array(spark, f"{path}/part=*")


@query("q_read_prompts", ops="A3, D17", views=("prompts",), oracle=f"""
select instance_id, text_inputs from ({_PROMPTS_LOADED}) p
""")
def q_read_prompts(spark, sf_dir):
    """A large file of earlier prompts and a small one of later ones."""
    p, path = fixture(spark, sf_dir, "prompts"), new_area(spark, "prompts")
    late = F.col("pos") >= 1_000_000
    for name, rows in (("a", p.where(~late)), ("b", p.where(late))):
        FS.write_jsonl(rows.select("instance_id", "text_inputs"), f"{path}/{name}")
    return FS.read_prompts(spark, f"{path}/*").select("instance_id", "text_inputs")


def _log_files(spark, sf_dir):
    """One folder and text file per job log."""
    path = new_area(spark, "logs")
    folder = F.concat(F.lit("instance_id="), F.coalesce("instance_id", F.lit("__HIVE_DEFAULT_PARTITION__")))
    LS.write_lines(fixture(spark, sf_dir, "logs").select(folder.alias("folder"), F.col("logs").alias("value")), path, "log.txt")
    return path


@query("q_read_logs", ops="A6", views=("logs",), oracle="""
select instance_id, logs || chr(10) as logs from logs
""")
def q_read_logs(spark, sf_dir):
    r = FS.read_logs(spark, f"{_log_files(spark, sf_dir)}/*")
    return r.select(F.regexp_extract("path", "instance_id=([^/]+)/", 1).alias("instance_id"), "logs")


@query("q_artifact_manifest", ops="A10", views=("logs",), oracle="""
select 's3://bucket/run/instance_id=' || instance_id as folder, cast(octet_length(encode(logs)) + 1 as bigint) as length
from logs
""")
def q_artifact_manifest(spark, sf_dir):
    m = FS.artifact_manifest(spark, _log_files(spark, sf_dir), "s3://bucket/run/")
    return m.select(F.regexp_replace("key", "/[^/]+$", "").alias("folder"), "length")


_BATCHES_SQL = """
b as (select r.*, cast(substr(instance_id, 7) as bigint) as k, cast(substr(instance_id, 7) as bigint) % 40 as n from instance_results r),
lost as (select distinct n from b where k % 1700 = 901)
"""


@query("q_batch_results", ops="F1, B11, F4", views=("instance_results",), oracle=f"""
, {_BATCHES_SQL}
select b.instance_id, case when l.n is null then cast(b.n as varchar) end as batch, l.n is null as returned,
  case when l.n is null then b.error else 'Worker batch failed' end as error,
  case when l.n is null then b.resolved else false end as resolved
from b left join lost l on l.n = b.n
""")
def q_batch_results(spark, sf_dir):
    """Results left as files by worker batches; a batch with a line that was
    cut off is lost whole and its tasks become error rows."""
    r, path = fixture(spark, sf_dir, "instance_results"), new_area(spark, "batches")
    k = F.substring("instance_id", 7, 1 << 20).cast("bigint")
    line = F.to_json(F.struct("instance_id", "error", "patch_exists", "resolved"), {"ignoreNullFields": "false"})
    cut = F.when(k % 1700 == 901, F.left(line, F.length(line) - 5)).otherwise(line)
    (r.select((k % 40).cast("string").alias("batch"), cut.alias("value")).repartition("batch")
     .write.partitionBy("batch").text(path))
    whole, _ = FS.read_batches(spark, path, "instance_id string, error string, patch_exists boolean, resolved boolean")
    return J.returned_or_error(r, whole.drop("patch_exists")).select("instance_id", "batch", "returned", "error", "resolved")


def _store_files(spark, sf_dir, cond=None):
    """Files of a prediction store: most hold a prediction, some folders
    have another name, broken JSON, a list, no id or no prediction at all."""
    d = table(spark, sf_dir, "documents")
    d = d if cond is None else d.where(cond)
    kind, name = F.col("doc_id") % 10, F.concat(F.lit("inst__"), F.col("doc_id").cast("string"))
    record = F.to_json(F.struct(F.when(kind != 7, name).alias("instance_id"), F.col("text").alias("model_patch"),
                                F.concat(F.lit("model-"), F.col("lang")).alias("model_name_or_path")))
    content = F.when(kind == 8, F.lit('{"instance_id": "inst__')).when(kind == 5, F.lit('["inst__0"]')).otherwise(record)
    return d.select(F.when(kind == 6, F.concat(F.lit("copy-"), name)).otherwise(name).alias("folder"),
                    F.when(kind == 9, F.lit("notes.json")).otherwise(F.lit(ST.FILE)).alias("file"), content.alias("content"))


_STORED_SQL = """
select 'inst__' || doc_id as instance_id, text as model_patch, 'model-' || lang as model_name_or_path
from documents where doc_id % 10 not in (5, 7, 8, 9)
"""


@query("q_prediction_store", ops="A4", oracle=_STORED_SQL)
def q_prediction_store(spark, sf_dir):
    """A store of one folder an instance, listed and read in tasks."""
    path = new_area(spark, "store")
    ST.write_store(_store_files(spark, sf_dir), path)
    return ST.read_store(spark, path, prefixes=("inst__", "copy-")).drop("source_file")


@query("q_store_stream", ops="A4, J1", oracle=f"""
select s.*, cast(substr(instance_id, 7) as bigint) % 3 = 0 as second_run from ({_STORED_SQL}) s
""")
def q_store_stream(spark, sf_dir):
    """The store as a stream, run twice: the second run reads only the files
    that were written after the first."""
    area = new_area(spark, "store-stream")
    for run, cond in enumerate((F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 == 0)):
        ST.write_store(_store_files(spark, sf_dir, cond), f"{area}/store")
        time.sleep(0.05)                               # the files' time is over
        stream = ST.stream_store(spark, f"{area}/store", settle_ms=1).drop("source_file")
        run_append(stream.withColumn("second_run", F.lit(run == 1)), f"{area}/out", f"{area}/ckpt")
    return spark.read.parquet(f"{area}/out")


def _even_length(row: dict) -> tuple[str, float, dict]:
    """A per-row check: fails on some patches, skips others."""
    n = len(row["patch"])
    if n % 11 == 0:
        raise ValueError(f"bad length {n}")
    return ("skipped", 0.0, {}) if n % 7 == 0 else ("ok", 1.0 - n % 2, {"length": n})


def _short(contexts):
    return contexts.select("instance_id", F.lit("ok").alias("status"),
                           F.when(F.length("patch") < 1000, F.lit(1.0)).otherwise(F.lit(0.25)).alias("score"))


@query("q_verifier_run", ops="I1, B10, B13, F2, F3", oracle="""
with d as (select cast(doc_id as varchar) as instance_id, length(text) as n from documents),
r as (
  select instance_id, 'short' as name, 'ok' as status, cast(case when n < 1000 then 1.0 else 0.25 end as double) as score,
    cast(0.5 as double) as pass_threshold, '{}' as details, 1 as ord, true as run_intermediate, false as run_final from d
  union all
  select instance_id, 'even_length', case when n % 11 = 0 then 'error' when n % 7 = 0 then 'skipped' else 'ok' end,
    cast(case when n % 11 = 0 or n % 7 = 0 then 0.0 else 1 - n % 2 end as double), cast(1.0 as double),
    case when n % 11 = 0 then '{"error": "bad length ' || n || '", "error_type": "ValueError"}'
         when n % 7 = 0 then '{}' else '{"length": ' || n || '}' end, 2, true, true from d)
select *, status = 'ok' and score >= pass_threshold as passed from r
""")
def q_verifier_run(spark, sf_dir):
    known = [V.PythonVerifier("even_length", "dynamic", _even_length), V.ColumnVerifier("short", "static", _short, 0.5),
             V.ColumnVerifier("unused", "static", _short)]
    config = V.verifier_config(known, ["short", "even_length"], ["even_length"], spark)
    contexts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("instance_id"),
                                                        F.col("text").alias("patch"))
    results = V.run_verifier_set(contexts, known, ["short", "even_length"])
    return (S.with_passed(results).drop("wall_clock_seconds")
            .join(config.select("name", "ord", "run_intermediate", "run_final"), "name"))


#: seconds and memory of a checked program
RUN_SECONDS, RUN_MB = 3.0, 128


def _run_program(row: dict) -> tuple[str, float, dict]:
    """Runs a program's function: a value of 0 or more passes."""
    space: dict = {}
    exec(row["patch"], space)  # noqa: S102 - in the guarded child process
    value = space["f"]()
    return "ok", float(value >= 0), {"value": value}


@query("q_guarded_run", ops="I1, I2, B13", views=("programs",), oracle=f"""
select instance_id, case when pos % 1999 = 7 then 'timeout'
    when pos % 251 = 9 or pos % 127 = 5 or pos % 113 = 4 or pos % 11 = 3 then 'error' else 'ok' end as status,
  cast(case when pos % 1999 = 7 or pos % 251 = 9 or pos % 127 = 5 or pos % 113 = 4 or pos % 11 = 3 or pos % 7 = 2
       then 0.0 else 1.0 end as double) as score,
  case when pos % 1999 = 7 then null when pos % 251 = 9 then 'MemoryError' when pos % 127 = 5 or pos % 113 = 4 then 'ProcessDied'
       when pos % 11 = 3 then 'IndexError' end as error_type,
  case when pos % 1999 = 7 then null when pos % 251 = 9 then '' when pos % 127 = 5 then 'the check process ended with status 3'
       when pos % 113 = 4 then 'the check process was ended by signal 11' when pos % 11 = 3 then 'list index out of range' end as error_message,
  case when pos % 1999 = 7 then cast({RUN_SECONDS} as double) end as limit_seconds,
  not (pos % 1999 = 7 or pos % 251 = 9 or pos % 127 = 5 or pos % 113 = 4 or pos % 11 = 3 or pos % 7 = 2) as passed
from programs
""")
def q_guarded_run(spark, sf_dir):
    """Every program is run: one that never ends, eats memory or ends its
    process gives one row of its own, and its neighbours are unharmed."""
    check = V.PythonVerifier("run", "dynamic", _run_program, 1.0, timeout_seconds=RUN_SECONDS, memory_mb=RUN_MB)
    results = S.with_passed(check.run(fixture(spark, sf_dir, "programs").select("instance_id", "patch")))
    note = {"error_type": "string", "error_message": "string", "limit_seconds": "double"}
    paths = {"error_type": "$.error_type", "error_message": "$.error", "limit_seconds": "$.timeout"}
    return results.select("instance_id", "status", "score", "passed",
                          *[F.get_json_object("details", paths[n]).cast(k).alias(n) for n, k in note.items()])


@query("q_validated", ops="B15", views=("verifier_results",), oracle="""
select instance_id, name, pass_threshold, score as weight from verifier_results
""")
def q_validated(spark, sf_dir):
    """Recorded thresholds and weights, every one of them checked."""
    r = fixture(spark, sf_dir, "verifier_results").withColumnRenamed("score", "weight")
    return S.validate_config(r).select("instance_id", "name", "pass_threshold", "weight")


@query("q_config_problems", ops="B15", views=("verifier_results",), oracle="""
select instance_id, name, case when t < 0 or t > 1 then 'pass_threshold must be in [0.0, 1.0], got ' || t
    else 'Weight for ' || chr(39) || name || chr(39) || ' must be non-negative, got ' || w end as problem
from (select instance_id, name, cast(instance_id % 8 as double) / 4 - 0.5 as t, score - cast(instance_id % 3 as double) / 4 as w
      from verifier_results) r
where t < 0 or t > 1 or w < 0
""")
def q_config_problems(spark, sf_dir):
    """The thresholds and weights that validation refuses, and why."""
    r = fixture(spark, sf_dir, "verifier_results")
    config = r.select("instance_id", "name", ((F.col("instance_id") % 8).cast("double") / 4 - 0.5).alias("pass_threshold"),
                      (F.col("score") - (F.col("instance_id") % 3).cast("double") / 4).alias("weight"))
    return S.config_problems(config).select("instance_id", "name", "problem")


@query("q_aggregators", ops="D4, D1-D3", views=("verifier_results",), oracle="""
select instance_id, avg(e) as mean, min(e) as min, sum(e) / count(*) as weighted_sum
from (select instance_id, case when status = 'ok' then score else cast(0.0 as double) end as e from verifier_results) r
group by instance_id
""")
def q_aggregators(spark, sf_dir):
    """Every aggregator by its name, equal weights."""
    r = S.with_weights(fixture(spark, sf_dir, "verifier_results"), None)
    return r.groupBy("instance_id").agg(*[S.build_aggregator(n)().alias(n) for n in ("mean", "min", "weighted_sum")])
