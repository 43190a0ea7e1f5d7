"""Joins and keyed dedupe.

All joins are equi-joins on string/bigint ids.  Callers may have a side of a checked
row count broadcast (``small_side``); the library leaves its joins to the
planner and AQE (sort-merge with runtime broadcast conversion and skew-split
when a key is hot).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DATASET_ALIASES, NO_PROMPT  # noqa: F401

from ..functions.text import truthy

# A broadcast side must stay below this many rows (config tables, alias
# dictionaries, verifier sets).  Anything larger is joined by shuffle.
BROADCAST_MAX_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows, else return it
    unchanged so the planner shuffles it.  The check reads only up to
    ``max_rows + 1`` rows."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def join_back(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``facts``, an aggregate of one row per
    ``key``.  Null keys meet like any other key.

    The join is on the key wrapped in a struct.  An aggregate is partitioned
    by its key, and joined on the bare key it would be read straight from
    its own shuffle, a shape in which AQE does not split a hot key of
    ``rows``; on the wrapped key the (small) aggregate is shuffled anew and
    AQE can split."""
    facts = facts.select(F.struct(F.col(key)).alias("_key"), *[c for c in facts.columns if c != key])
    return rows.join(facts, F.struct(rows[key]) == F.col("_key"), how).drop("_key")


# ---------------------------------------------------------------- A3 / D17
def last_wins(df: DataFrame, key: str | list[str], order: list[str] | str) -> DataFrame:
    """Keep the last row per key in ``order`` (a dict build where later
    rows overwrite earlier ones).

    ``max_by`` over a struct aggregates partially before the shuffle, so a
    key holding a third of the rows is reduced map-side before the
    shuffle (``dropDuplicates`` would keep an arbitrary row instead).
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order]) if len(order) > 1 else F.col(order[0])
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*[F.col(c) for c in rest]), ordering).alias("_last"))
            .select(*keys, "_last.*"))


def load_prompts(prompts: DataFrame) -> DataFrame:
    """A3: drop records whose id or text is empty or missing, then the last
    record per id (file order ``pos``) wins."""
    kept = prompts.filter(truthy(F.col("instance_id")) & truthy(F.col("text_inputs")))
    return last_wins(kept.select("instance_id", "pos", "text_inputs"), "instance_id", "pos")


# ---------------------------------------------------------------- C1-C3, B11
def resume_pending(dataset: DataFrame, completed: DataFrame) -> DataFrame:
    """Instances without a stored prediction (failed runs saved one too,
    so they are not retried)."""
    return dataset.join(completed.select("instance_id"), "instance_id", "left_anti")


def merge_predictions(dataset: DataFrame, predictions: DataFrame) -> DataFrame:
    """Dataset-order inner join; ids outside the dataset dropped,
    repeated dataset ids repeat, defaults for missing fields (B2)."""
    return (dataset.select("instance_id", "pos")
            .join(predictions, "instance_id")
            .select("pos", "instance_id",
                    F.coalesce(F.col("model_patch"), F.lit("")).alias("model_patch"),
                    F.coalesce(F.col("model_name_or_path"), F.lit("unknown")).alias("model_name_or_path"))
            .orderBy("pos"))


def missing_prompts(pending: DataFrame, prompts: DataFrame) -> DataFrame:
    """Pending instances without a usable prompt, in dataset order."""
    return pending.join(prompts.select("instance_id"), "instance_id", "left_anti")


def first_missing(pending: DataFrame, prompts: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` missing ids shown in the warning (a top-k report)."""
    return missing_prompts(pending, prompts).orderBy("pos").limit(n).select("pos", "instance_id")




def prompt_or_error(pending: DataFrame, prompts: DataFrame, model_name: str) -> DataFrame:
    """Every pending instance yields a row; a missing prompt becomes an
    error row with an empty patch instead of being dropped."""
    j = pending.select("instance_id", "pos").join(
        prompts.select("instance_id", "text_inputs"), "instance_id", "left")
    missing = F.col("text_inputs").isNull()
    return j.select(
        "instance_id", "pos",
        F.when(missing, F.lit(NO_PROMPT)).alias("error"),
        F.when(missing, F.lit("")).alias("model_patch"),
        F.lit(model_name).alias("model_name_or_path"),
        (~missing).alias("has_prompt"))


# ---------------------------------------------------------------- C4
def samples_with_problems(samples: DataFrame, problems: DataFrame) -> DataFrame:
    """C4: every sample joined to its problem (last problem per id wins); a
    sample whose task is unknown fails the job, as the evaluator asserts."""
    probs = last_wins(problems, "task_id", "pos").drop("pos")
    j = samples.join(probs.withColumn("_found", F.lit(True)), "task_id", "left")
    # the guard sits in a filter so that column pruning cannot remove it
    guard = F.when(F.col("_found").isNull(),
                   F.raise_error(F.concat(F.lit("unknown task_id "), F.col("task_id"))).cast("boolean")
                   ).otherwise(F.lit(True))
    return j.filter(guard).drop("_found")


# ---------------------------------------------------------------- C8
def grade_tests(tests: DataFrame) -> DataFrame:
    """An instance is resolved iff every expected test (FAIL_TO_PASS and
    PASS_TO_PASS) was observed PASSED; a test that did not run (null
    status) counts as failing."""
    ok = F.coalesce(F.col("status") == "PASSED", F.lit(False))
    f2p = F.col("kind") == "FAIL_TO_PASS"
    return (tests.groupBy("instance_id")
            .agg(F.bool_and(ok).alias("resolved"),
                 F.sum(F.when(f2p & ok, 1).otherwise(0)).cast("bigint").alias("f2p_passed"),
                 F.sum(F.when(f2p, 1).otherwise(0)).cast("bigint").alias("f2p_total"),
                 F.sum(F.when(~f2p & ok, 1).otherwise(0)).cast("bigint").alias("p2p_passed"),
                 F.sum(F.when(~f2p, 1).otherwise(0)).cast("bigint").alias("p2p_total")))


def grade_predictions(tests: DataFrame, predictions: DataFrame) -> DataFrame:
    """C8 for whole predictions ``(instance_id, model_patch, error)``:
    ``patch_exists`` is a non-empty patch; an empty patch, a grading error
    and an instance without observed tests are unresolved."""
    graded = grade_tests(tests).select("instance_id", F.col("resolved").alias("_ok"))
    exists = F.coalesce(F.col("model_patch") != "", F.lit(False))
    return (predictions.join(graded, "instance_id", "left")
            .select("instance_id", exists.alias("patch_exists"),
                    (exists & F.col("error").isNull() & F.coalesce("_ok", F.lit(False))).alias("resolved"), "error"))


# ---------------------------------------------------------------- C10
def patches_generated(dataset: DataFrame, stored: DataFrame) -> DataFrame:
    """Dataset rows that have a stored prediction (semi join)."""
    return (dataset.join(stored.select("instance_id"), "instance_id", "left_semi")
            .agg(F.count(F.lit(1)).alias("patches_generated"),))


# ---------------------------------------------------------------- B8


def resolve_alias(df: DataFrame, name_col: str, out: str = "subset") -> DataFrame:
    """Map dataset names to subset names; unknown names map to themselves.
    The alias table has 13 rows, so it is broadcast."""
    spark = df.sparkSession
    aliases = spark.createDataFrame(DATASET_ALIASES, "alias_name string, alias_subset string")
    return (df.join(F.broadcast(aliases), F.col(name_col) == F.col("alias_name"), "left")
            .withColumn(out, F.coalesce(F.col("alias_subset"), F.col(name_col)))
            .drop("alias_name", "alias_subset"))


def returned_or_error(tasks: DataFrame, results: DataFrame, error: str = "Worker batch failed") -> DataFrame:
    """F1 + B11: one row for every task: its result, or an error row with an
    unresolved result where no batch returned one."""
    fields = [c for c in results.columns if c not in ("instance_id", "error", "resolved")]
    j = tasks.select("instance_id").join(results.withColumn("_returned", F.lit(True)), "instance_id", "left")
    returned = F.coalesce("_returned", F.lit(False))
    return j.select("instance_id", *fields, returned.alias("returned"),
                    F.when(returned, F.col("error")).otherwise(F.lit(error)).alias("error"),
                    F.when(returned, F.col("resolved")).otherwise(F.lit(False)).alias("resolved"))


def union_results(*batches: DataFrame) -> DataFrame:
    """results of all batches; a lost batch simply contributes no rows
    (found later by a left join from the task table)."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out

