"""Verifier extension point: per-row error isolation in the Python adapter,
Column verifiers, set construction defaults (B10/F3) and static+dynamic
union (F2)."""

from __future__ import annotations

import json
import os
import signal
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from rewardlake.operators import patches as P
from rewardlake.operators import scoring as S
from rewardlake.operators import verifier as V
from rewardlake.operators.guard import Guard
from rewardlake.shipping import ship_by_value

# the check functions below run in Python workers; ship them with the task
ship_by_value(__name__)


def _contexts(spark):
    return spark.createDataFrame([("a", "+x = 1"), ("b", "boom"), ("c", "")], "instance_id string, patch string")


def _check(row):
    if row["patch"] == "boom":
        raise RuntimeError("exploded")
    return ("ok", 1.0 if row["patch"] else 0.0, {"n": len(row["patch"])})


def test_python_verifier_isolates_rows(spark):
    v = V.PythonVerifier("len_check", "static", _check, pass_threshold=1.0)
    got = {r.instance_id: r for r in v.run(_contexts(spark)).collect()}
    assert (got["a"].status, got["a"].score) == ("ok", 1.0)
    assert (got["b"].status, got["b"].score) == ("error", 0.0)
    assert json.loads(got["b"].details) == {"error": "exploded", "error_type": "RuntimeError"}
    passed = {r.instance_id: r.passed for r in S.with_passed(v.run(_contexts(spark))).collect()}
    assert passed == {"a": True, "b": False, "c": False}


def test_column_verifier_and_set(spark):
    col_v = V.ColumnVerifier("non_empty", "static", lambda df: df.select(
        "instance_id", F.lit("ok").alias("status"),
        F.when(F.col("patch") != "", 1.0).otherwise(0.0).alias("score")))
    py_v = V.PythonVerifier("swe_test", "dynamic", _check, pass_threshold=0.5)
    cfg = V.verifier_config([col_v, py_v], intermediate=["non_empty"], final=None, spark=spark)
    rows = [tuple(r) for r in cfg.orderBy("ord").collect()]
    assert rows == [(1, "non_empty", "static", True, False, 1.0, 1.0),
                    (2, "swe_test", "dynamic", False, True, 0.5, 1.0)]
    res = V.run_verifier_set(_contexts(spark), [col_v, py_v], ["non_empty", "swe_test"])
    assert res.count() == 6
    with pytest.raises(ValueError):
        V.verifier_config([col_v], intermediate=["nope"], final=["non_empty"], spark=spark)


def _odd(row):
    patch = row["patch"]
    if patch == "endless":
        while True:
            pass
    if patch == "memory":
        held = []
        while True:
            held.append(bytearray(1 << 25))
    if patch == "exit":
        os._exit(7)
    if patch == "quit":
        sys.exit("left")
    if patch == "child":
        subprocess.Popen(["sleep", "300"])
        time.sleep(300)
    return "ok", 1.0, {"pid": os.getpid()}


def test_running_checks_are_stopped(spark):
    """A check that hangs, eats memory or ends its process costs one row and
    its limit; the rows around it are checked."""
    kinds = ["fine", "endless", "fine", "memory", "fine", "exit", "quit", "child", "fine"]
    rows = spark.createDataFrame(list(enumerate(kinds)), "instance_id int, patch string").coalesce(1) \
        .select(F.col("instance_id").cast("string").alias("instance_id"), "patch")
    v = V.PythonVerifier("odd", "dynamic", _odd, timeout_seconds=2.0, memory_mb=128)
    start = time.monotonic()
    got = sorted(v.run(rows).collect(), key=lambda r: int(r.instance_id))
    assert time.monotonic() - start < 60
    assert [r.status for r in got] == ["ok", "timeout", "ok", "error", "ok", "error", "error", "timeout", "ok"]
    assert [json.loads(r.details).get("error_type") for r in got] == [
        None, None, None, "MemoryError", None, "ProcessDied", "SystemExit", None, None]
    assert json.loads(got[1].details) == {"timeout": 2.0} and got[1].score == 0.0 and 2.0 <= got[1].wall_clock_seconds < 6
    assert json.loads(got[5].details)["error"] == "the check process ended with status 7"
    # a killed process is replaced
    pids = [json.loads(got[i].details)["pid"] for i in (0, 2, 4, 8)]
    assert len(set(pids)) >= 3
    # nothing that was started is left
    time.sleep(0.2)
    assert not any(os.path.exists(f"/proc/{p}") for p in pids)


def test_guard_answers_in_order_and_restarts():
    def fn(x):
        if x < 0:
            os.kill(os.getpid(), signal.SIGKILL)
        if x == 0:
            time.sleep(60)
        return "x" * x
    with Guard(fn, 0.5) as guard:
        first = guard(5_000_000)
        assert first.kind == "ok" and len(first.value) == 5_000_000
        pid = guard.pid
        assert guard(3).value == "xxx" and guard.pid == pid
        assert guard(0)[:2] == ("timeout", 0.5) and guard(2).value == "xx" and guard.pid != pid
        assert guard(-1)[:2] == ("died", "the check process was ended by signal 9") and guard(1).value == "x"
        assert guard("a")[:2] == ("raised", ("TypeError", "'<' not supported between instances of 'str' and 'int'"))
    assert guard.pid == 0
    with Guard(lambda x: (lambda: x), 1) as guard:         # a result that cannot be sent
        assert guard(1).kind == "raised"


def test_hanging_parse_is_stopped():
    def check(patch, limit):
        if "hang" in (patch or ""):
            while True:
                pass
        return P.check_patch(patch, limit)
    good = "--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b = 1\n"
    bad = good.replace("b = 1", "b = (")
    got = P.guarded_verdicts([good, good + "hang", bad, None, "", "+++ a.md"], 0.0, check=check)
    # the limit of 0 also makes the check's own clock strike between hunks
    assert [v["status"] for v in got] == ["timeout", "timeout", "timeout", "skipped", "skipped", "skipped"]
    got = P.guarded_verdicts([good, bad, good.replace("b = 1", "(" * 100_000)], 30.0)
    assert [(v["status"], v["score"]) for v in got][:2] == [("ok", 1.0), ("ok", 0.0)] and got[2]["score"] == 0.0


def test_outcomes_keep_error_notes(spark):
    rows = [("a", "v", "error", 1.0, 0.5, 1.0, '{"error":"no file","error_type":"OSError"}'), ("b", "v", "error", 1.0, 0.5, 1.0, "{}"),
            ("c", "v", "error", 1.0, 0.5, 99.0, '{"error":"late"}'), ("d", "v", "ok", 1.0, 0.5, 1.0, '{"error":"none"}'),
            ("e", "v", "error", 1.0, 0.5, None, None), ("f", "v", "error", 1.0, 0.5, 1.0, "not json")]
    results = spark.createDataFrame(rows, "instance_id string, name string, status string, score double, pass_threshold double, "
                                          "wall_clock_seconds double, details string")
    config = spark.createDataFrame([("v", 1.0)], "name string, pass_threshold double")
    limits = spark.createDataFrame([("v", 60.0)], "name string, timeout_seconds double")
    got = {r.instance_id: (r.status, r.score, r.error_type, r.error_message, r.limit_seconds)
           for r in S.normalise_outcomes(results, config, limits).collect()}
    assert got == {"a": ("error", 0.0, "OSError", "no file", None), "b": ("error", 0.0, None, None, None),
                   "c": ("timeout", 0.0, None, None, 60.0), "d": ("ok", 1.0, None, None, None),
                   "e": ("error", 0.0, None, None, None), "f": ("error", 0.0, None, None, None)}
    assert "error_type" not in S.normalise_outcomes(results.drop("details"), config, limits).columns
