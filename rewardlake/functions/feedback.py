"""Feedback text shown to the model between turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ALL_PASSED, FAILING_STATUSES, FEEDBACK_HEADER, LOG_TAIL, PLEASE_REVISE, SHOWN_TESTS, WHOLE_LOG_BELOW

#: what a recorded result's ``details`` JSON may hold for the two verifiers with feedback of their own
DETAILS = ("error string, errors array<struct<file:string,line:int,offset:int,message:string,snippet:string>>, "
           "patch_successfully_applied boolean, tests_status map<string,string>")


#: verifiers with feedback of their own
OWN_WORDING = ("ast_check", "swe_test")

#: splits a double into two halves of 26 bits, whose products are exact
_SPLIT = float((1 << 27) + 1)


def score_2dp(score: Column) -> Column:
    """A non-negative score with two decimals, as Python's ``:.2f`` gives it:
    the double itself (not its shortest decimal) is rounded, ties to even.
    200 * score is taken as a rounded product and its exact error, so the
    comparison with the half cent is exact (SURVEY Q9)."""
    x, times = score.cast("double"), 200.0
    high = x * _SPLIT - (x * _SPLIT - x)
    product = x * times
    error = (high * times - product) + (x - high) * times
    cents = F.floor(x * 100)
    over = (product - (2 * cents + 1).cast("double")) + error
    rounded = cents + F.when((over > 0) | ((over == 0) & (cents % 2 == 1)), F.lit(1)).otherwise(F.lit(0))
    return F.concat(F.floor(rounded / 100).cast("string"), F.lit("."), F.lpad((rounded % 100).cast("string"), 2, "0"))


def _passed(status: Column, score: Column, threshold: Column) -> Column:
    return F.coalesce((status == "ok") & (score >= threshold), F.lit(False))


def feedback_line(name: Column, status: Column, score: Column, threshold: Column) -> Column:
    """``[name] STATUS`` for non-ok results, else PASSED/FAILED with the
    score."""
    ok_line = F.concat(F.when(_passed(status, score, threshold), F.lit("PASSED")).otherwise(F.lit("FAILED")),
                       F.lit(" (score: "), score_2dp(score), F.lit(")"))
    body = F.when(status != "ok", F.upper(status)).otherwise(ok_line)
    return F.concat(F.lit("["), name, F.lit("] "), body)


def syntax_line(status: Column, score: Column, threshold: Column, errors: Column) -> Column:
    """The syntax verifier's feedback; one entry per error, in order."""
    def entry(e):
        line, offset = F.coalesce(e["line"], F.lit(0)), F.coalesce(e["offset"], F.lit(0))
        return F.concat(
            F.lit("\n  - "), F.coalesce(e["file"], F.lit("?")), F.lit(": "),
            F.when(line != 0, F.concat(F.lit("line "), line.cast("string"))).otherwise(F.lit("")),
            F.when(offset != 0, F.concat(F.lit(", offset "), offset.cast("string"))).otherwise(F.lit("")),
            F.lit(": "), F.coalesce(e["message"], F.lit("syntax error")),
            F.when(F.coalesce(e["snippet"], F.lit("")) != "", F.concat(F.lit("\n"), e["snippet"])).otherwise(F.lit("")))

    listed = F.coalesce(F.array_join(F.transform(errors, entry), ""), F.lit(""))
    return (F.when(status != "ok", F.concat(F.lit("[ast_check] "), F.upper(status)))
            .when(_passed(status, score, threshold), F.lit("[ast_check] PASSED: no syntax errors detected"))
            .otherwise(F.concat(F.lit("[ast_check] FAILED: syntax errors in the following files:"), listed)))


def failing_tests(status_map: Column) -> Column:
    """Names of tests whose status is FAILED or ERROR, in recorded order."""
    return F.map_keys(F.map_filter(status_map, lambda k, v: v.isin(*FAILING_STATUSES)))


def unit_test_line(status: Column, score: Column, threshold: Column, error: Column, applied: Column,
                   failing: Column, stdout: Column) -> Column:
    """The unit-test verifier's feedback text."""
    head = F.concat(F.lit("[swe_test] FAILED (score: "), score_2dp(score), F.lit(")"))
    n = F.size(failing)
    listed = F.when(n > 0, F.concat(
        F.lit("\n  Failing tests ("), n.cast("string"), F.lit("):\n"),
        F.array_join(F.transform(F.slice(failing, 1, SHOWN_TESTS), lambda t: F.concat(F.lit("    - "), t)), "\n"),
        F.when(n > SHOWN_TESTS, F.concat(F.lit("\n    ... and "), (n - SHOWN_TESTS).cast("string"),
                                         F.lit(" more"))).otherwise(F.lit("")))).otherwise(F.lit(""))
    out = F.coalesce(stdout, F.lit(""))
    log = (F.when(out == "", F.lit(""))
           .when(F.length(out) < WHOLE_LOG_BELOW,
                 F.concat(F.lit("\n\n  Test output:\n  "), F.replace(out, F.lit("\n"), F.lit("\n  "))))
           .otherwise(F.concat(F.lit(f"\n\n  Test output (last {LOG_TAIL} chars):\n  "),
                               F.replace(F.right(out, F.lit(LOG_TAIL)), F.lit("\n"), F.lit("\n  ")))))
    failed = F.when(~F.coalesce(applied, F.lit(False)),
                    F.concat(head, F.lit("\n  The patch could not be applied to the repository."))
                    ).otherwise(F.concat(head, listed, log))
    return (F.when(status != "ok", F.concat(F.lit("[swe_test] "), F.upper(status), F.lit(": "),
                                           F.coalesce(error, F.lit("unknown error"))))
            .when(_passed(status, score, threshold), F.lit("[swe_test] PASSED: issue resolved"))
            .otherwise(failed))


def format_feedback(name: Column, status: Column, score: Column, threshold: Column, details: Column,
                    stdout: Column) -> Column:
    """A result's feedback as its verifier words it.  ``details`` is the
    recorded struct (``DETAILS``); verifiers without wording of their own use
    the generic line."""
    failing = F.coalesce(failing_tests(details["tests_status"]), F.array().cast("array<string>"))
    return (F.when(name == "ast_check", syntax_line(status, score, threshold, details["errors"]))
            .when(name == "swe_test", unit_test_line(status, score, threshold, details["error"],
                                                     details["patch_successfully_applied"], failing, stdout))
            .otherwise(feedback_line(name, status, score, threshold)))


def feedback_message(ordered: DataFrame) -> DataFrame:
    """Per instance, header + each result's own feedback in config order
    + closing line.  ``ordered`` has one row per (instance, configured
    verifier) -- a bounded group -- with ``ord``, ``name``, ``status``,
    ``score``, ``pass_threshold`` and, where recorded, ``details`` (JSON) and
    ``stdout``."""
    has = set(ordered.columns)
    stdout = F.col("stdout") if "stdout" in has else F.lit(None).cast("string")
    status, score, limit = F.col("status"), F.col("score"), F.col("pass_threshold")
    # only what did not pass is worded from its details
    worded = F.col("name").isin(*OWN_WORDING) & ~_passed(status, score, limit)
    noted = F.when(worded, F.col("details") if "details" in has else F.lit(None).cast("string"))
    details = F.when(noted.isNotNull(), F.from_json(noted, DETAILS))
    g = (ordered.withColumn("_details", details)
         .withColumn("_line", format_feedback(F.col("name"), status, score, limit, F.col("_details"), stdout))
         .groupBy("instance_id")
         .agg(F.sort_array(F.collect_list(F.struct("ord", "_line"))).alias("ls"),
              F.bool_and(_passed(status, score, limit)).alias("ap")))
    closing = F.when(F.col("ap"), F.lit(ALL_PASSED)).otherwise(F.lit(PLEASE_REVISE))
    return g.select("instance_id",
                    F.concat(F.lit(FEEDBACK_HEADER), F.lit("\n"), F.array_join("ls._line", "\n"), F.lit("\n"), closing)
                    .alias("feedback"))
