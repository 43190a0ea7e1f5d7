"""Job outcomes and unit-test results.

Test statuses of an instance form a bounded group (the tests of one task),
so building its ``map<test, status>`` with ``collect_list`` is safe; all
per-instance work is one ``groupBy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SHOWN_TESTS

from ..functions.feedback import failing_tests, unit_test_line

#: G20, the unit-test verifier's feedback text
test_feedback = unit_test_line


def job_outcome(jobs: DataFrame) -> DataFrame:
    """Succeeded > 0 -> ok; failed > 0 -> timed out iff a condition is
    (Failed, DeadlineExceeded).  Error text: 'timed_out', none, or
    'job_failed'.  ``conditions`` is built from the recorded reason."""
    conditions = F.when(F.col("reason").isNotNull(),
                        F.array(F.struct(F.lit("Failed").alias("type"), F.col("reason").alias("reason")))
                        ).otherwise(F.array().cast("array<struct<type:string,reason:string>>"))
    ok = F.coalesce(F.col("succeeded") > 0, F.lit(False))
    failed = F.coalesce(F.col("failed") > 0, F.lit(False))
    timed_out = ~ok & failed & F.exists(conditions, lambda c: (c["type"] == "Failed")
                                        & (c["reason"] == "DeadlineExceeded"))
    return jobs.select("instance_id", ok.alias("succeeded"), timed_out.alias("timed_out"),
                       F.when(timed_out, F.lit("timed_out")).when(ok, F.lit(None).cast("string"))
                       .otherwise(F.lit("job_failed")).alias("error"), "test_output")


def test_outcome(outcomes: DataFrame, resolved: Column, grading_error: Column | None = None) -> DataFrame:
    """The unit-test verifier's ladder: a job error -> error; no test
    output -> error ('K8s Job timed out' or 'No test output captured from
    pod logs'); a failed grading (``grading_error`` not null) -> error with its
    message; otherwise ok with score 1.0 if resolved else 0.0."""
    failed = grading_error if grading_error is not None else F.lit(None).cast("string")
    has_error = F.coalesce(F.col("error") != "", F.lit(False))
    no_output = ~F.coalesce(F.col("test_output") != "", F.lit(False))
    wrong = has_error | no_output | failed.isNotNull()
    status = F.when(wrong, F.lit("error")).otherwise(F.lit("ok"))
    message = (F.when(has_error, F.col("error"))
               .when(no_output, F.when(F.col("timed_out"), F.lit("K8s Job timed out"))
                     .otherwise(F.lit("No test output captured from pod logs")))
               .otherwise(failed))
    score = F.when(wrong, F.lit(0.0)).when(resolved, F.lit(1.0)).otherwise(F.lit(0.0))
    return outcomes.select("instance_id", status.alias("status"), score.alias("score"), message.alias("message"))


def tests_status(tests: DataFrame) -> DataFrame:
    """Per instance ``map<test, status>`` (tests that did not run are absent).

    With a column ``pos`` (the order of recording) a test recorded more than
    once has its last status, and the map is in the order in which the tests
    were first recorded; without it, the largest status text, by name."""
    ran = tests.filter(F.col("status").isNotNull()).groupBy("instance_id", "test")
    if "pos" in tests.columns:
        one = ran.agg(F.max_by("status", "pos").alias("status"), F.min("pos").alias("at"))
    else:
        one = ran.agg(F.max("status").alias("status")).withColumn("at", F.col("test"))
    return (one.groupBy("instance_id")
            .agg(F.sort_array(F.collect_list(F.struct("at", "test", "status"))).alias("_t"))
            .select("instance_id", F.map_from_arrays("_t.test", "_t.status").alias("tests_status")))


def failing_top(tests: DataFrame, n: int = SHOWN_TESTS) -> DataFrame:
    """The first ``n`` failing tests and how many more there are."""
    f = tests_status(tests).select("instance_id", failing_tests(F.col("tests_status")).alias("failing"))
    return f.select("instance_id", F.size("failing").cast("bigint").alias("n_failing"),
                    F.array_join(F.slice("failing", 1, n), ",").alias("shown"),
                    F.greatest(F.size("failing") - n, F.lit(0)).cast("bigint").alias("n_more"))
