"""Expected results on chosen rows for the text operators, written out by
hand from the stated behaviour."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rewardlake.functions import text as T


def _one(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r[0] for r in df.select("i", fn(F.col("s")).alias("o")).orderBy("i").select("o").collect()]


@pytest.mark.parametrize("text, want", [
    ("<bash> ls -l </bash>", ("bash", "ls -l")),
    ("first <submit/> then <bash>ls</bash>", ("submit", "")),
    ("<bash>a\nb</bash> <submit />", ("bash", "a\nb")),
    ("<bash>one</bash><bash>two</bash>", ("bash", "one")),
    ("  plain command ", ("bash", "plain command")),
    (" \n ", ("submit", "")),
    ("<bash>never closed", ("bash", "<bash>never closed")),
])
def test_tool_calls(spark, text, want):
    [got] = _one(spark, T.tool_call, [text])
    assert tuple(got) == want


@pytest.mark.parametrize("text, want", [
    ("out\n__RC_8372916__:0\n", ("out", 0)),
    ("a __RC_8372916__:17\nb", ("a b", 17)),
    ("no sentinel ", ("no sentinel ", -1)),
    ("", ("", -1)),
])
def test_exit_codes(spark, text, want):
    [got] = _one(spark, T.exit_code_split, [text])
    assert tuple(got) == want


def test_log_patch(spark):
    logs = [f"x\n{T.PATCH_START}\ndiff --git a/f b/f\n{T.PATCH_END}\ny", f"only {T.PATCH_START} here", "", "nothing"]
    assert _one(spark, T.log_patch, logs) == ["diff --git a/f b/f", "", "", ""]
