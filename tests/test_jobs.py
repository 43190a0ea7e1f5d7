"""Unit-test verifier feedback branches the fixture does not reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardlake.operators import jobs as JB


def _fb(spark, rows):
    df = spark.createDataFrame(rows, "status string, score double, err string, applied boolean, "
                                     "failing array<string>, out string")
    c = JB.test_feedback(F.col("status"), F.col("score"), F.lit(1.0), F.col("err"), F.col("applied"),
                         F.col("failing"), F.col("out"))
    return [r[0] for r in df.select(c).collect()]


FAILED = "[swe_test] FAILED (score: 0.00)"
SHOWN = "".join(f"\n    - t{i:02d}" for i in range(20))


def test_test_feedback_branches(spark):
    many = [f"t{i:02d}" for i in range(25)]
    cases = [
        (("error", 0.0, "K8s Job timed out", True, [], ""), "[swe_test] ERROR: K8s Job timed out"),
        (("timeout", 0.0, None, True, [], ""), "[swe_test] TIMEOUT: unknown error"),
        (("ok", 1.0, None, True, [], "log"), "[swe_test] PASSED: issue resolved"),
        (("ok", 0.0, None, False, ["a"], "log"), FAILED + "\n  The patch could not be applied to the repository."),
        (("ok", 0.0, None, True, many, "line1\nline2"),
         FAILED + "\n  Failing tests (25):" + SHOWN + "\n    ... and 5 more\n\n  Test output:\n  line1\n  line2"),
        (("ok", 0.0, None, True, ["x"], "y\n" * 2500),
         FAILED + "\n  Failing tests (1):\n    - x\n\n  Test output (last 3000 chars):\n  " + "y\n  " * 1500),
        (("ok", 0.0, None, True, [], ""), FAILED),
    ]
    assert _fb(spark, [row for row, _ in cases]) == [want for _, want in cases]


def test_a_test_recorded_twice_does_not_end_the_job(spark):
    rows = [(1, "t", "FAILED", 0), (1, "t", "PASSED", 1), (1, "u", "PASSED", 0), (1, "u", "ERROR", 1)]
    df = spark.createDataFrame(rows, "instance_id long, test string, status string, pos int")
    [r] = JB.failing_top(df).collect()
    assert (r.n_failing, r.shown) == (1, "u")
    assert JB.tests_status(df.drop("pos")).count() == 1


def test_failing_top_caps_at_twenty(spark):
    rows = [(1, f"t{i:02d}", "FAILED" if i % 2 else "ERROR") for i in range(23)] + [(1, "ok", "PASSED"), (2, "z", None)]
    df = spark.createDataFrame(rows, "instance_id long, test string, status string")
    got = {r.instance_id: r for r in JB.failing_top(df).collect()}
    assert got[1].n_failing == 23 and got[1].n_more == 3 and got[1].shown.count(",") == 19
    assert 2 not in got  # an instance whose tests never ran has no status map
