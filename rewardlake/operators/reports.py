"""Run and grading reports.

All reports are global or grouped aggregations: Spark computes partial
counts per partition (map-side combine) and merges them in one small final
stage, so the input is never gathered anywhere.  Instance id lists are kept
as a long table (``report_ids``), never as arrays in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truthy


def count_where(cond: Column) -> Column:
    """Number of rows where ``cond`` is true, as BIGINT."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, 0.0 when ``den`` is 0 (Python ``x / n if n else 0``)."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- D6 / D5
def precedence_bucket(error: Column, patch_exists: Column, resolved: Column) -> Column:
    """First match wins: error (not null) -> 'error'; no patch -> 'empty';
    resolved -> 'passed'; otherwise 'failed'."""
    return (F.when(error.isNotNull(), F.lit("error"))
            .when(~F.coalesce(patch_exists, F.lit(False)), F.lit("empty"))
            .when(F.coalesce(resolved, F.lit(False)), F.lit("passed"))
            .otherwise(F.lit("failed")))


def with_bucket(results: DataFrame) -> DataFrame:
    return results.withColumn(
        "bucket", precedence_bucket(F.col("error"), F.col("patch_exists"), F.col("resolved")))


def base_report(results: DataFrame) -> DataFrame:
    """Total, passed, failed (= everything not passed), errors, empty, pass_rate."""
    b = F.col("bucket")
    return (with_bucket(results)
            .agg(F.count(F.lit(1)).alias("total"),
                 count_where(b == "passed").alias("passed"),
                 count_where(b != "passed").alias("failed"),
                 count_where(b == "error").alias("errors"),
                 count_where(b == "empty").alias("empty"))
            .withColumn("pass_rate", safe_ratio(F.col("passed"), F.col("total"))))


def resolve_report(results: DataFrame) -> DataFrame:
    """D6 with the benchmark's output names."""
    return base_report(results).select(
        F.col("total").alias("total_instances"),
        F.col("passed").alias("resolved_instances"),
        F.col("failed").alias("unresolved_instances"),
        F.col("errors").alias("error_instances"),
        F.col("empty").alias("empty_patch_instances"),
        F.col("pass_rate").alias("resolve_rate"))


def report_ids(results: DataFrame) -> DataFrame:
    """The id lists of D6 as a long table ``(list_name, instance_id)``.

    An error row is listed in both ``error_ids`` and ``unresolved_ids``; an
    empty or failed row in ``unresolved_ids``; a passed row in
    ``resolved_ids``.  Narrow (no shuffle): one explode per row.
    """
    b = F.col("bucket")
    lists = (F.when(b == "error", F.array(F.lit("error_ids"), F.lit("unresolved_ids")))
             .when(b == "passed", F.array(F.lit("resolved_ids")))
             .otherwise(F.array(F.lit("unresolved_ids"))))
    return (with_bucket(results)
            .select(F.explode(lists).alias("list_name"), "instance_id"))


# ---------------------------------------------------------------- B6 / D7
def eval_flags(results: DataFrame) -> DataFrame:
    """Error is a *truthy* string ('' is not an error); evaluated = no
    error and resolved known; resolved strictly TRUE among evaluated."""
    is_error = truthy(F.col("error"))
    evaluated = ~is_error & F.col("resolved").isNotNull()
    return results.select(
        "instance_id",
        is_error.alias("is_error"),
        evaluated.alias("evaluated"),
        (evaluated & (F.col("resolved") == F.lit(True))).alias("is_resolved"))


def run_results(results: DataFrame) -> DataFrame:
    """The aggregate results file of a run."""
    f = eval_flags(results)
    return (f.agg(F.count(F.lit(1)).alias("total_instances"),
                  count_where(F.col("evaluated")).alias("evaluated"),
                  count_where(F.col("is_resolved")).alias("resolved_instances"),
                  count_where(F.col("is_error")).alias("error_instances"))
            .select(
                "total_instances", "evaluated",
                safe_ratio(F.col("evaluated"), F.col("total_instances")).alias("completion_rate"),
                "resolved_instances",
                (F.col("evaluated") - F.col("resolved_instances")).alias("unresolved_instances"),
                "error_instances",
                safe_ratio(F.col("resolved_instances"), F.col("evaluated")).alias("resolve_rate")))


def run_result_ids(results: DataFrame) -> DataFrame:
    """The id lists of D7 as a long table ``(list_name, instance_id)``: errors
    by the truthy rule, resolved strictly TRUE among the evaluated.  Narrow:
    no shuffle."""
    name = F.when(F.col("is_error"), F.lit("error_ids")).when(F.col("is_resolved"), F.lit("resolved_ids"))
    return eval_flags(results).select(name.alias("list_name"), "instance_id").where(F.col("list_name").isNotNull())


def completion_results(samples: DataFrame) -> DataFrame:
    """D10's per-sample results, each with the id list it belongs to: a sample
    passed iff its ``result`` is 'passed'."""
    passed = F.coalesce(F.col("result") == "passed", F.lit(False))
    return samples.select("task_id", "result", passed.alias("passed"),
                          F.when(passed, F.lit("passed_ids")).otherwise(F.lit("failed_ids")).alias("list_name"))


# ---------------------------------------------------------------- D9 / A12
RUN_METRIC_KEYS = ("total_instances", "patches_generated", "generation_errors",
                   "evaluated", "completion_rate", "resolved", "resolve_rate")


def run_metrics(results: DataFrame, evaluated_run: bool = True) -> DataFrame:
    """The tracked metrics of a run as ``(key, value)`` rows.

    Three base metrics always; the four evaluation metrics only when the run
    evaluated patches (multi-turn, or agent with evaluation)."""
    f = results.select(
        truthy(F.col("error")).alias("is_error"),
        F.coalesce(F.col("patch_exists"), F.lit(False)).alias("has_patch"),
        F.col("resolved"))
    evaluated = ~F.col("is_error") & F.col("resolved").isNotNull()
    wide = f.agg(
        F.count(F.lit(1)).cast("double").alias("total_instances"),
        count_where(F.col("has_patch")).cast("double").alias("patches_generated"),
        count_where(F.col("is_error")).cast("double").alias("generation_errors"),
        count_where(evaluated).cast("double").alias("evaluated"),
        count_where(evaluated & (F.col("resolved") == F.lit(True))).cast("double").alias("resolved"))
    wide = wide.select(
        "*",
        safe_ratio(F.col("evaluated"), F.col("total_instances")).alias("completion_rate"),
        safe_ratio(F.col("resolved"), F.col("evaluated")).alias("resolve_rate"))
    keys = RUN_METRIC_KEYS if evaluated_run else RUN_METRIC_KEYS[:3]
    return wide.unpivot([], list(keys), "key", "value")


def tracking_rows(results: DataFrame, run_id: str, params: dict[str, str],
                  evaluated_run: bool = True) -> DataFrame:
    """Long experiment-tracking table ``(run_id, kind, key, num_value, str_value)``.

    Metrics come from the data (D9); params are the run's configuration and
    are attached as literal rows to the same result.
    """
    metrics = run_metrics(results, evaluated_run).select(
        F.lit(run_id).alias("run_id"), F.lit("metric").alias("kind"), "key",
        F.col("value").alias("num_value"), F.lit(None).cast("string").alias("str_value"))
    if not params:
        return metrics
    spark = results.sparkSession
    prow = spark.createDataFrame([(run_id, "param", k, None, str(v)) for k, v in params.items()],
                                 "run_id string, kind string, key string, num_value double, str_value string")
    return metrics.unionByName(prow)


#: params of every run, then those of its strategy, then those of a multi-turn run
RUN_PARAMS = ("strategy", "model_name", "dataset", "split", "run_id", "num_workers", "instance_limit", "max_turns")
STRATEGY_PARAMS = {"naive": ("max_tokens", "temperature")}
AGENT_PARAMS = ("agent_config", "step_limit", "cost_limit")
TURN_PARAMS = ("intermediate_verifiers", "aggregator")


def tracked_params(configs: DataFrame) -> DataFrame:
    """The params of many runs as ``(run_id, key, value)``, from one
    config row a run: those of every run, of its strategy and, beyond one
    turn, of the multi-turn loop; a param without a value is left out, and so
    is a column that the configs do not have."""
    multi = F.col("max_turns").cast("int") > 1
    when = {**{k: F.lit(True) for k in RUN_PARAMS},
            **{k: F.col("strategy") == s for s, ks in STRATEGY_PARAMS.items() for k in ks},
            **{k: ~F.col("strategy").isin(*STRATEGY_PARAMS) for k in AGENT_PARAMS},
            **{k: multi for k in TURN_PARAMS}}
    have = [k for k in when if k in configs.columns]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.when(when[k], F.col(k).cast("string")).alias("value")) for k in have])
    return (configs.select("run_id", F.explode(entries).alias("e")).select("run_id", "e.*")
            .filter(F.col("value").isNotNull()))


def tracked_runs(results: DataFrame, configs: DataFrame) -> DataFrame:
    """A12 + D9 for many runs at once: the long tracking rows of every run in
    ``configs`` (a run without results has zero counts).  ``results`` has a
    ``run_id``; the evaluation metrics come only for runs that evaluate: of
    several turns, or agent runs with ``run_eval``."""
    f = results.select("run_id", truthy(F.col("error")).alias("is_error"),
                       F.coalesce(F.col("patch_exists"), F.lit(False)).alias("has_patch"), F.col("resolved"))
    evaluated = ~F.col("is_error") & F.col("resolved").isNotNull()
    counts = f.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_instances"), count_where(F.col("has_patch")).alias("patches_generated"),
        count_where(F.col("is_error")).alias("generation_errors"), count_where(evaluated).alias("evaluated"),
        count_where(evaluated & F.col("resolved")).alias("resolved"))
    multi = F.col("max_turns").cast("int") > 1
    judges = F.coalesce(multi | ((F.col("strategy") == "agent") & F.col("run_eval")), F.lit(False))
    wide = configs.select("run_id", judges.alias("_judges")).join(counts, "run_id", "left")
    wide = wide.select("run_id", "_judges", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
                                              for c in ("total_instances", "patches_generated", "generation_errors", "evaluated", "resolved")])
    wide = wide.select("*", safe_ratio(F.col("evaluated"), F.col("total_instances")).alias("completion_rate"),
                       safe_ratio(F.col("resolved"), F.col("evaluated")).alias("resolve_rate"))
    metrics = (wide.unpivot(["run_id", "_judges"], list(RUN_METRIC_KEYS), "key", "num_value")
               .filter(F.col("_judges") | F.col("key").isin(*RUN_METRIC_KEYS[:3])))
    params = tracked_params(configs).withColumnRenamed("value", "str_value")
    return (metrics.select("run_id", F.lit("metric").alias("kind"), "key", "num_value", F.lit(None).cast("string").alias("str_value"))
            .unionByName(params.select("run_id", F.lit("param").alias("kind"), "key", F.lit(None).cast("double").alias("num_value"), "str_value")))


# ---------------------------------------------------------------- A8
def artifact_plan(results: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """Which per-instance artifacts a run writes, one row per file.

    ``prediction.json`` and ``report.json`` always; the report is the eval
    report when one exists, else ``{"error": ...}``.  ``pod_logs.txt`` only
    when the instance has non-empty logs, ``<id>.traj.json`` only when the
    log carries a non-empty trajectory block.  Written with
    ``write.partitionBy(run_id)`` as one table per kind, never one folder per
    instance.
    """
    base = results.select(
        "instance_id",
        F.array(
            F.struct(F.lit("prediction.json").alias("artifact"), F.lit("prediction").alias("content")),
            F.struct(F.lit("report.json").alias("artifact"),
                     F.when(F.col("resolved").isNotNull(), F.lit("eval_report"))
                     .otherwise(F.lit("error")).alias("content"))).alias("files"))
    out = base.select("instance_id", F.inline("files"))
    if logs is not None:
        pod = (logs.filter(F.col("logs").isNotNull() & (F.col("logs") != ""))
               .join(results.select("instance_id"), "instance_id", "left_semi")
               .select("instance_id", F.lit("pod_logs.txt").alias("artifact"),
                       F.lit("logs").alias("content")))
        from ..functions.text import log_trajectory
        traj = (logs.withColumn("_traj", log_trajectory(F.col("logs"))).filter(F.col("_traj") != "")
                .join(results.select("instance_id"), "instance_id", "left_semi")
                .select("instance_id", F.concat(F.col("instance_id"), F.lit(".traj.json")).alias("artifact"),
                        F.lit("trajectory").alias("content")))
        out = out.unionByName(pod).unionByName(traj)
    return out


# ---------------------------------------------------------------- C6
def final_eval(instances: DataFrame, results: DataFrame, verifier: str = "swe_test") -> DataFrame:
    """Per instance, the report of the final result named ``verifier``.

    The unit-test verifier scores 1.0 exactly when the instance is resolved
    and records ``resolved`` only when its status is ok; a missing result or
    a non-ok one gives an empty report whose ``resolved`` defaults to false.
    Of several results with that name the first recorded one counts.
    """
    from .scoring import first_recorded
    named = first_recorded(results.filter(F.col("name") == verifier), ["instance_id"], ["status", "score"])
    ok = F.col("r.status") == "ok"
    return (instances.select("instance_id").join(named, "instance_id", "left")
            .select("instance_id",
                    F.col("r.status").alias("status"),
                    F.coalesce(ok, F.lit(False)).alias("has_report"),
                    F.coalesce(ok & (F.col("r.score") >= 1.0), F.lit(False)).alias("resolved")))


def final_eval_report(evals: DataFrame) -> DataFrame:
    """C6 + SURVEY Q19: instances, resolved, and -- since a failed test
    verifier yields an empty report that counts as evaluated and unresolved
    -- how many of those unresolved ones are verifier failures rather than
    model failures."""
    err = F.col("status").isNotNull() & (F.col("status") != "ok")
    return evals.agg(F.count(F.lit(1)).alias("instances"),
                     count_where(F.col("resolved")).alias("resolved_instances"),
                     count_where(~F.col("resolved")).alias("unresolved_instances"),
                     count_where(err).alias("verifier_error_instances"),
                     count_where(F.col("status").isNull()).alias("no_result_instances"))
