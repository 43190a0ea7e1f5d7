"""Verifier outcomes and score aggregation (SURVEY B3-B5, B13, B15, C5, C7,
D1-D4, D18, F2).

Verifier results are a long table ``(instance_id, name, status, score,
pass_threshold, ...)``; a verifier set is a small config table
``(ord, name, mode, run_intermediate, run_final, pass_threshold, weight)``.
Aggregators are Column factories used inside one ``groupBy(instance_id)``,
so every score is a hash aggregate with map-side partial aggregation --
a hot instance never lands whole in one task before being reduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_TIMEOUT, VERIFIER_TIMEOUTS  # noqa: F401

STATUSES = ("ok", "error", "timeout", "skipped")


def effective_score(status: Column, score: Column) -> Column:
    """The result's score when status is ok, else 0.0."""
    return F.when(status == F.lit("ok"), score.cast("double")).otherwise(F.lit(0.0))


def passed(status: Column, score: Column, threshold: Column) -> Column:
    """Ok and score >= threshold; error/timeout/skipped never pass."""
    return F.coalesce((status == F.lit("ok")) & (score >= threshold), F.lit(False))


def with_passed(results: DataFrame) -> DataFrame:
    return results.withColumn(
        "passed", passed(F.col("status"), F.col("score"), F.col("pass_threshold")))


def config_problem(config: DataFrame) -> Column:
    """What is wrong with a row's threshold (outside [0, 1])
    or weight (negative); null where nothing is."""
    t = F.col("pass_threshold")
    problem = F.when((t < 0) | (t > 1), F.concat(F.lit("pass_threshold must be in [0.0, 1.0], got "),
                                                  t.cast("string")))
    if "weight" in config.columns:
        w = F.col("weight")
        problem = F.coalesce(problem, F.when(w < 0, F.concat(F.lit("Weight for '"), F.col("name"),
                                                             F.lit("' must be non-negative, got "),
                                                             w.cast("string"))))
    return problem


def config_problems(config: DataFrame) -> DataFrame:
    """B15 as a report: the rows that ``validate_config`` refuses, each with
    its ``problem``."""
    return config.withColumn("problem", config_problem(config)).filter(F.col("problem").isNotNull())


def validate_config(config: DataFrame) -> DataFrame:
    """Thresholds outside [0, 1] and negative weights fail the job.

    The checks are a filter (not a projected column), so they run even when
    a later ``select`` prunes the checked columns."""
    problem = config_problem(config)
    return config.filter(F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean"))
                         .otherwise(F.lit(True)))


def subset(config: DataFrame, which: str) -> DataFrame:
    """The intermediate or final schedule of a verifier set."""
    flag = {"intermediate": "run_intermediate", "final": "run_final"}[which]
    return config.filter(F.col(flag))


def first_recorded(results: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The first recorded result per ``keys`` by ``pos`` (the order of
    recording).  Tables without ``pos`` hold one result per key; should there
    be more, the smallest record is taken so that the answer is stable."""
    record = F.struct(*fields)
    one = F.min_by(record, F.struct("pos", record)) if "pos" in results.columns else F.min(record)
    return results.groupBy(*keys).agg(one.alias("r"))


def results_in_order(results: DataFrame, config: DataFrame) -> DataFrame:
    """Results aligned to the configured verifiers: joined by name, in
    config order, results of unconfigured verifiers dropped, the first
    recorded result per name.  ``details`` and ``stdout`` come along where
    the results have them."""
    cfg = validate_config(config).select("ord", "name")
    fields = ["status", "score", "pass_threshold", *[c for c in ("details", "stdout") if c in results.columns]]
    first = first_recorded(results, ["instance_id", "name"], fields)
    return first.join(cfg, "name").select("instance_id", "ord", "name", "r.*")


def normalise_outcomes(results: DataFrame, config: DataFrame,
                       timeouts: DataFrame) -> DataFrame:
    """What the safe wrapper records.

    * a run longer than the verifier's timeout becomes (timeout, 0.0)
    * a verifier exception (recorded status 'error') becomes (error, 0.0)
    * the configured threshold overwrites the one the result carried
    * where the results have ``details``: what the error said and its type,
      and the limit that a timed-out run went over
    ``timeouts`` is ``(name, timeout_seconds)``.
    """
    cfg = (validate_config(config).select("name", F.col("pass_threshold").alias("cfg_threshold")))
    lim = timeouts
    j = results.join(cfg, "name", "left").join(lim, "name", "left")
    over = F.col("wall_clock_seconds") > F.coalesce(F.col("timeout_seconds"), F.lit(DEFAULT_TIMEOUT))
    status = (F.when(over, F.lit("timeout"))
              .when(F.col("status") == "error", F.lit("error"))
              .otherwise(F.col("status")))
    score = F.when(over | (F.col("status") == "error"), F.lit(0.0)).otherwise(F.col("score"))
    notes = []
    if "details" in results.columns:
        failed = ~over & (F.col("status") == "error")
        notes = [F.when(failed, F.get_json_object("details", "$.error")).alias("error_message"),
                 F.when(failed, F.get_json_object("details", "$.error_type")).alias("error_type"),
                 F.when(over, F.coalesce(F.col("timeout_seconds"), F.lit(DEFAULT_TIMEOUT))).alias("limit_seconds")]
    return j.select("instance_id", "name", status.alias("status"), score.alias("score"),
                    F.coalesce(F.col("cfg_threshold"), F.col("pass_threshold")).alias("pass_threshold"),
                    "wall_clock_seconds", *notes)


# ------------------------------------------------------------- aggregators
def mean_score() -> Column:
    """D1 (inside groupBy): mean effective score."""
    return F.avg(effective_score(F.col("status"), F.col("score")))


def min_score() -> Column:
    """D2 (inside groupBy): minimum effective score."""
    return F.min(effective_score(F.col("status"), F.col("score")))


def weighted_score() -> Column:
    """D3 (inside groupBy, needs a ``w`` column): sum(eff * w) / sum(w), 1.0
    when the weights sum to 0."""
    num = F.sum(effective_score(F.col("status"), F.col("score")) * F.col("w"))
    den = F.sum(F.col("w"))
    return F.when(den == 0.0, F.lit(1.0)).otherwise(num / den)


AGGREGATORS = {"mean": mean_score, "min": min_score, "weighted_sum": weighted_score}


def build_aggregator(name: str):
    """Aggregator by name; unknown names raise."""
    try:
        return AGGREGATORS[name]
    except KeyError:
        raise ValueError(f"Unknown aggregator '{name}'. Choose from: mean, min, weighted_sum") from None


def with_weights(results: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Name -> weight lookup, default 1.0; a negative weight fails."""
    if weights is None:
        return results.withColumn("w", F.lit(1.0))
    wt = (validate_config(weights.select("name", "weight", F.lit(0.5).alias("pass_threshold")))
                    .select("name", F.col("weight").alias("w_cfg")))
    return (results.join(wt, "name", "left")
            .withColumn("w", F.coalesce(F.col("w_cfg"), F.lit(1.0))).drop("w_cfg"))


def aggregate_scores(instances: DataFrame, results: DataFrame, aggregator: str = "mean",
                     weights: DataFrame | None = None, skipped: str = "zero") -> DataFrame:
    """Per-instance aggregate score; an instance with no results scores 1.0.

    ``groupBy`` never emits an empty group, so the empty set comes from the
    left join from ``instances``.  ``skipped='zero'`` (default) scores a
    skipped verifier 0.0 as the recorded runs do (SURVEY Q8);
    ``skipped='exclude'`` leaves skipped results out of the aggregate.
    """
    if skipped not in ("zero", "exclude"):
        raise ValueError("skipped must be 'zero' or 'exclude'")
    if skipped == "exclude":
        results = results.filter(F.col("status") != "skipped")
    agg = build_aggregator(aggregator)
    if aggregator == "weighted_sum":
        results = with_weights(results, weights)
    per = results.groupBy("instance_id").agg(agg().alias("agg_score"))
    return (instances.select("instance_id").join(per, "instance_id", "left")
            .select("instance_id", F.coalesce(F.col("agg_score"), F.lit(1.0)).alias("score")))


def all_passed(instances: DataFrame, results: DataFrame) -> DataFrame:
    """AND over ``passed``; an instance without results is true."""
    per = (with_passed(results).groupBy("instance_id")
           .agg(F.bool_and("passed").alias("ap")))
    return (instances.select("instance_id").join(per, "instance_id", "left")
            .select("instance_id", F.coalesce(F.col("ap"), F.lit(True)).alias("all_passed")))




def split_by_mode(results: DataFrame, config: DataFrame) -> DataFrame:
    """Per instance, how many results came from static (inline) and from
    dynamic (isolated) verifiers, and whether its set is dynamic at all."""
    cfg = (config.select("name", "mode"))
    j = results.join(cfg, "name")
    return (j.groupBy("instance_id")
            .agg(F.count_if(F.col("mode") == "static").alias("static_results"),
                 F.count_if(F.col("mode") == "dynamic").alias("dynamic_results"),
                 F.bool_or(F.col("mode") == "dynamic").alias("is_dynamic")))


def static_then_dynamic(results: DataFrame, config: DataFrame) -> DataFrame:
    """static results (run inline) and dynamic results (run isolated)
    are produced separately, unioned, and put back in config order (C5)."""
    cfg = (config.select("ord", "name", "mode"))
    j = with_passed(results).join(cfg, "name")
    static = j.filter(F.col("mode") == "static")
    dynamic = j.filter(F.col("mode") == "dynamic")
    return (static.unionByName(dynamic)
            .select("instance_id", "ord", "name", "mode", "passed"))
