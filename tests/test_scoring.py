"""Scoring rules and properties (SURVEY §5 (c)): empty sets score 1.0,
skipped never passes, D1 = D3 with equal weights, D2 <= D1, report buckets
add up, group advantages centre on zero, invalid configs fail."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from rewardlake.operators import reports as R
from rewardlake.operators import rollout as RO
from rewardlake.operators import scoring as S
from tests.conftest import SF_SMALL

RES = "instance_id long, name string, status string, score double, pass_threshold double"


def _inst(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "instance_id long")


def test_empty_and_skipped(spark):
    res = spark.createDataFrame([(1, "a", "skipped", 1.0, 1.0), (1, "b", "ok", 1.0, 1.0),
                                 (2, "a", "ok", 0.5, 0.5)], RES)
    inst = _inst(spark, [1, 2, 3])
    mean = dict(S.aggregate_scores(inst, res, "mean").collect())
    assert mean == {1: 0.5, 2: 0.5, 3: 1.0}  # skipped contributes 0.0 (Q8); no results -> 1.0
    ap = dict(S.all_passed(inst, res).collect())
    assert ap == {1: False, 2: True, 3: True}


def test_weights(spark):
    res = spark.createDataFrame([(1, "a", "ok", 1.0, 1.0), (1, "b", "ok", 0.0, 1.0)], RES)
    inst = _inst(spark, [1])
    w = spark.createDataFrame([("a", 3.0), ("c", 1.0)], "name string, weight double")
    assert S.aggregate_scores(inst, res, "weighted_sum", w).first()["score"] == pytest.approx(0.75)
    zero = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "name string, weight double")
    assert S.aggregate_scores(inst, res, "weighted_sum", zero).first()["score"] == 1.0
    neg = spark.createDataFrame([("a", -1.0)], "name string, weight double")
    with pytest.raises(Exception, match="must be non-negative"):
        S.aggregate_scores(inst, res, "weighted_sum", neg).collect()
    with pytest.raises(ValueError):
        S.build_aggregator("median")


def test_threshold_validation(spark):
    cfg = spark.createDataFrame([(1, "a", 1.5)], "ord int, name string, pass_threshold double")
    with pytest.raises(Exception, match="pass_threshold must be in"):
        S.validate_config(cfg).collect()


def test_aggregator_properties_on_fixture(spark):
    q = E.queries()
    mean = dict(q["q_agg_mean"](spark, SF_SMALL).collect())
    mn = dict(q["q_agg_min"](spark, SF_SMALL).collect())
    from rewardlake.sources.fixtures import fixture
    from rewardlake.sources.tables import table
    inst = table(spark, SF_SMALL, "documents").select(F.col("doc_id").alias("instance_id"))
    vr = fixture(spark, SF_SMALL, "verifier_results")
    equal = vr.select("name").distinct().withColumn("weight", F.lit(2.0))
    weighted = dict(S.aggregate_scores(inst, vr, "weighted_sum", equal).collect())
    assert mean.keys() == mn.keys() == weighted.keys()
    for k in mean:
        assert mn[k] <= mean[k] + 1e-12
        assert weighted[k] == pytest.approx(mean[k])


def test_report_buckets_add_up(spark):
    q = E.queries()
    r = q["q_resolve_report"](spark, SF_SMALL).first()
    assert r.resolved_instances + r.unresolved_instances == r.total_instances
    ids = q["q_resolve_ids"](spark, SF_SMALL).groupBy("list_name").count().collect()
    counts = {x["list_name"]: x["count"] for x in ids}
    assert counts.get("resolved_ids", 0) == r.resolved_instances
    assert counts.get("unresolved_ids", 0) == r.unresolved_instances
    assert counts.get("error_ids", 0) == r.error_instances


def test_report_on_empty_input(spark):
    empty = spark.createDataFrame([], "instance_id string, error string, patch_exists boolean, resolved boolean")
    r = R.resolve_report(empty).first()
    assert (r.total_instances, r.resolve_rate) == (0, 0.0)
    rr = R.run_results(empty).first()
    assert (rr.completion_rate, rr.resolve_rate) == (0.0, 0.0)


def test_precedence_and_truthy_error(spark):
    rows = [("a", "boom", False, True), ("b", "", True, True), ("c", None, False, True),
            ("d", None, True, True), ("e", None, True, None)]
    df = spark.createDataFrame(rows, "instance_id string, error string, patch_exists boolean, resolved boolean")
    b = {r.instance_id: r.bucket for r in R.with_bucket(df).collect()}
    # '' is an error for the precedence report (not null) ...
    assert b == {"a": "error", "b": "error", "c": "empty", "d": "passed", "e": "failed"}
    # ... but not for the run results (truthy)
    f = {r.instance_id: (r.is_error, r.evaluated) for r in R.eval_flags(df).collect()}
    assert f["b"] == (False, True) and f["e"] == (False, False)


def test_group_advantage_centres(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0), (1, 3, 1.0), (2, 1, 1.0)],
                               "prompt_id long, sample int, reward double")
    a = RO.group_advantage(df).collect()
    by = {}
    for r in a:
        by.setdefault(r.prompt_id, []).append(r.advantage)
    assert sum(by[1]) == pytest.approx(0.0, abs=1e-9)
    assert by[2] == [0.0]


def test_retry_rules(spark):
    rows = [(1, 1, True, 0.0), (1, 2, True, 0.0), (1, 3, True, 0.0),          # all failing -> discarded
            (2, 1, True, 0.0), (2, 2, True, 0.0), (2, 3, False, 1.0),         # success on the third
            (3, 1, True, 0.0), (3, 2, True, 0.0), (3, 3, True, 0.0), (3, 4, False, 1.0)]  # beyond the cap
    df = spark.createDataFrame(rows, "rollout_id long, attempt int, infra_error boolean, reward double")
    got = {r.rollout_id: (r.used_attempt, r.reward, r.discarded) for r in RO.resolve_retries(df).collect()}
    assert got == {1: (None, None, True), 2: (3, 1.0, False), 3: (None, None, True)}


def test_sample_with_unknown_task_fails(spark):
    from rewardlake.operators.joins import samples_with_problems
    s = spark.createDataFrame([("t1", "x"), ("t9", "y")], "task_id string, response string")
    p = spark.createDataFrame([("t1", 0, "p", "t", "f"), ("t1", 1, "p2", "t", "f")],
                              "task_id string, pos long, prompt string, test string, entry_point string")
    with pytest.raises(Exception, match="unknown task_id t9"):
        samples_with_problems(s, p).collect()
    ok = samples_with_problems(s.filter("task_id = 't1'"), p).first()
    assert ok.prompt == "p2"  # duplicate problem id: last wins


def test_bad_threshold_fails_even_when_pruned(spark):
    res = spark.createDataFrame([(1, "a", "ok", 1.0, 1.0)], RES)
    cfg = spark.createDataFrame([(1, "a", 1.5)], "ord int, name string, pass_threshold double")
    with pytest.raises(Exception, match="pass_threshold must be in"):
        S.results_in_order(res, cfg).collect()


def test_replay_without_intermediate_verifiers(spark):
    from rewardlake.operators.dialog import replay_early_exit
    t = spark.createDataFrame([(1, 0, "a", True, 0.2), (1, 1, "b", True, 0.4), (1, 2, "c", False, 0.6)],
                              "instance_id long, turn int, output string, all_passed boolean, aggregate_score double")
    with_set = [(r.turn, r.exits) for r in replay_early_exit(t, 3).orderBy("turn").collect()]
    assert with_set == [(0, True)]
    without = [(r.turn, r.exits, r.has_feedback, r.aggregate_score)
               for r in replay_early_exit(t, 2, has_intermediate=False).orderBy("turn").collect()]
    assert without == [(0, False, False, 1.0), (1, False, False, 1.0)]


def test_artifact_plan_optional_files(spark):
    from rewardlake.functions.text import TRAJ_START, TRAJ_END
    res = spark.createDataFrame([("a", None, True, True), ("b", "x", False, None)],
                                "instance_id string, error string, patch_exists boolean, resolved boolean")
    logs = spark.createDataFrame([("a", f"log {TRAJ_START}[1]{TRAJ_END}"), ("b", ""), ("zz", "orphan")],
                                 "instance_id string, logs string")
    got = sorted(tuple(r) for r in R.artifact_plan(res, logs).collect())
    assert got == [("a", "a.traj.json", "trajectory"), ("a", "pod_logs.txt", "logs"),
                   ("a", "prediction.json", "prediction"), ("a", "report.json", "eval_report"),
                   ("b", "prediction.json", "prediction"), ("b", "report.json", "error")]


def test_skipped_exclude_option(spark):
    res = spark.createDataFrame([(1, "a", "skipped", 1.0, 1.0), (1, "b", "ok", 1.0, 1.0),
                                 (2, "a", "skipped", 1.0, 1.0)], RES)
    inst = _inst(spark, [1, 2])
    assert dict(S.aggregate_scores(inst, res, "mean").collect()) == {1: 0.5, 2: 0.0}
    assert dict(S.aggregate_scores(inst, res, "mean", skipped="exclude").collect()) == {1: 1.0, 2: 1.0}
