"""Agent rollouts and rewards.

The step log is ``(episode, step, event_id, ts, action, exit_code,
stdout)``.  The episode reducer of the reference (reset -> step* ->
submit) becomes: the terminal step per episode is an aggregate (first
submit, or the step cap), rows after it are cut by a join, and the summary
is a grouped aggregate.  No ordered window is needed, so an episode holding
a third of all steps is still reduced map-side and split by AQE in the
joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_RETRIES, MAX_STEPS

from ..functions.patch import files_changed, patch_lines
from .joins import join_back
from .machines import Machine, scan

ADV_EPS = 1e-9        # our choice; the trainer's epsilon is not in the reference


def terminal_steps(steps: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """Per episode the terminal step: the first ``submit``, or the step
    cap when no submit comes first (forced submit).  Episodes that end
    neither way are still running and have no row."""
    g = (steps.groupBy("episode")
         .agg(F.min(F.when(F.col("action") == "submit", F.col("step"))).alias("first_submit"),
              F.max("step").alias("last_step")))
    end = F.least(F.coalesce(F.col("first_submit"), F.lit(max_steps)), F.lit(max_steps))
    return (g.filter(F.col("first_submit").isNotNull() | (F.col("last_step") >= max_steps))
            .select("episode", end.cast("int").alias("end_step"),
                    (F.col("first_submit").isNull() | (F.col("first_submit") > max_steps)).alias("forced")))


def cut_episodes(steps: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """Every step up to and including the terminal one; running
    episodes keep all their steps with ``is_terminal`` false."""
    term = terminal_steps(steps, max_steps)
    j = join_back(steps, term, "episode", "left")
    return (j.filter(F.col("end_step").isNull() | (F.col("step") <= F.col("end_step")))
            .select("episode", "step", "action", "exit_code", "stdout", "ts",
                    F.coalesce(F.col("step") == F.col("end_step"), F.lit(False)).alias("is_terminal"),
                    F.coalesce(F.col("forced") & (F.col("step") == F.col("end_step")), F.lit(False))
                    .alias("forced_submit")))


#: An episode runs until its first submit
EPISODES = Machine(("running", "ended"), ("submit", "bash"), moves={("running", "submit"): "ended"},
                   counts={"step": {("running", "submit"): 1, ("running", "bash"): 1}})


def cut_log(log: DataFrame, order: list[str], max_steps: int = MAX_STEPS) -> DataFrame:
    """E7 for a log without step numbers ``(episode, action, <order>...)``:
    every row up to the first submit or the step cap, numbered, in one
    associative scan (``machines.scan``) whatever an episode's length."""
    action = F.when(F.col("action") == "submit", F.lit("submit")).otherwise(F.lit("bash"))
    s = scan(log, ["episode"], order, EPISODES, action, state="_state")
    submit = F.coalesce(F.col("action") == "submit", F.lit(False))
    kept = s.filter((F.col("_state") == "running") & (F.col("step") <= max_steps)).drop("_state")
    return kept.select("*", (submit | (F.col("step") == max_steps)).alias("is_terminal"),
                       (~submit & (F.col("step") == max_steps)).alias("forced_submit"))


def episode_summary(steps: DataFrame, patches: DataFrame, graded: DataFrame,
                    max_steps: int = MAX_STEPS) -> DataFrame:
    """The summary a finished episode logs.

    Bash steps before the terminal one count output characters and non-zero
    exits; the submit step contributes no output.  ``patches`` is
    ``(episode, patch)``, ``graded`` is ``(episode, resolved)``; an empty
    patch is unresolved without grading.

    The step log is read by two branches only: the terminal-step aggregate,
    and one conditional aggregate over the steps joined to it.
    """
    s = steps.select("episode", "step", "action", "exit_code", "stdout")
    term = terminal_steps(s, max_steps)
    before = F.col("step") < F.col("end_step")
    counts = (join_back(s, term, "episode")
              .groupBy("episode")
              .agg(F.max("end_step").alias("steps"),
                   F.count_if(before & (F.col("exit_code") != 0)).alias("nonzero_exits"),
                   F.sum(F.when(before, F.length("stdout"))).alias("total_output_chars")))
    j = counts.join(patches, "episode", "left").join(graded, "episode", "left")
    patch = F.coalesce(F.col("patch"), F.lit(""))
    has_patch = patch != ""
    resolved = has_patch & F.coalesce(F.col("resolved"), F.lit(False))
    return j.select(
        "episode", F.col("steps").cast("bigint").alias("steps"),
        F.col("nonzero_exits").cast("bigint").alias("nonzero_exits"),
        F.coalesce(F.col("total_output_chars"), F.lit(0)).cast("bigint").alias("total_output_chars"),
        F.when(has_patch, patch_lines(patch)).otherwise(F.lit(0)).cast("bigint").alias("patch_lines"),
        F.when(has_patch, files_changed(patch)).otherwise(F.lit(0)).cast("bigint").alias("files_changed"),
        F.when(has_patch, F.lit(0.0)).otherwise(F.lit(1.0)).alias("empty_patch"),
        F.when(F.col("steps") <= 1, F.lit(1.0)).otherwise(F.lit(0.0)).alias("immediate_submit"),
        F.when(resolved, F.lit(1.0)).otherwise(F.lit(0.0)).alias("reward"))


def resolve_retries(attempts: DataFrame, retries: int = MAX_RETRIES) -> DataFrame:
    """E5: the first of up to ``1 + retries`` attempts without an
    infrastructure error is the rollout's result; none -> discarded."""
    usable = (F.col("attempt") <= retries + 1) & ~F.col("infra_error")
    g = (attempts.groupBy("rollout_id")
         .agg(F.min(F.when(usable, F.struct(F.col("attempt"), F.col("reward")))).alias("r")))
    return g.select("rollout_id", F.col("r.attempt").cast("bigint").alias("used_attempt"),
                    F.col("r.reward").alias("reward"), F.col("r").isNull().alias("discarded"))


def group_advantage(rollouts: DataFrame, key: str = "prompt_id", eps: float = ADV_EPS) -> DataFrame:
    """(reward - group mean) / (group sample std + eps); a group of one
    has std 0.  Group statistics are a partial aggregation joined back,
    so a prompt with a huge number of samples is reduced map-side and its
    join partition is split by AQE (``joins.join_back``)."""
    stats = rollouts.groupBy(key).agg(F.avg("reward").alias("g_mean"),
                                      F.coalesce(F.stddev_samp("reward"), F.lit(0.0)).alias("g_std"))
    return (join_back(rollouts, stats, key)
            .withColumn("advantage", (F.col("reward") - F.col("g_mean")) / (F.col("g_std") + F.lit(eps)))
            .drop("g_mean", "g_std"))


def elapsed(steps: DataFrame) -> DataFrame:
    """Wall-clock seconds from first to last step per episode, and run
    minutes to one decimal."""
    g = steps.groupBy("episode").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    secs = F.timestamp_diff("MICROSECOND", F.col("t0"), F.col("t1")) / F.lit(1e6)
    return g.select("episode", secs.alias("elapsed_seconds"), F.round(secs / 60.0, 1).alias("elapsed_minutes"))
