"""Labels as VARIANT (H4, H5) and logs read once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rewardlake.functions import text as T
from rewardlake.functions import variant as V
from rewardlake.operators import logs as LG


def test_labels_of_all_shapes_share_a_column(spark):
    text = spark.createDataFrame([('{"instance_id": "a", "n": 1}',), ('{"instance_id": 5}',), ("[1]",), ('"a"',), ("{",), ("",), (None,)], "label string")
    struct = spark.createDataFrame([(("b", 2),), ((None, 3),), (None,)], "label struct<instance_id: string, n: int>")
    maps = spark.createDataFrame([({"instance_id": "c"},), ({},)], "label map<string, string>")
    number = spark.createDataFrame([(7,)], "label int")
    rows = V.union_labels(text, struct, maps, number, text.select(F.try_parse_json("label").alias("label")))
    assert dict(rows.dtypes) == {"label": "variant"}
    got = [r[0] for r in rows.select(V.label_id(F.col("label"))).collect()]
    first = ["a", "5", "unknown", "unknown", "unknown", "unknown", "unknown"]
    assert sorted(got) == sorted([*first, "b", "unknown", "unknown", "c", "unknown", "unknown", *first])
    assert sorted(r[0] for r in rows.select(V.label_field(F.col("label"), "n", "bigint")).collect() if r[0] is not None) == [1, 1, 2, 3]


def test_label_fields_count_what_labels_have(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": "1"}',), ('{"a": 2}',), ("[1]",), ("no",), (None,)], "label string")
    got = sorted((r.field, r.type, r.n) for r in V.label_fields(rows.select(V.as_label(rows, "label").alias("label"))).collect())
    assert got == [("a", "BIGINT", 2), ("a", "STRING", 1), ("b", "STRING", 1)]


def _logs():
    def block(name, body):
        a, b = T.LOG_BLOCKS[name]
        return f"{a}\n{body}\n{b}\n"
    both = "boot\n" + block("patch", "  +x ") + block("preds", '{"i": {"instance_id": "i", "model_patch": "p"}}')
    return {"both": both, "twice": block("patch", "first") + block("patch", "second"), "open": T.LOG_BLOCKS["patch"][0] + "x",
            "reversed": T.LOG_BLOCKS["patch"][1] + "x" + T.LOG_BLOCKS["patch"][0], "empty": "", "none": None,
            "failed": T.APPLIED + "\n" + T.APPLY_FAILED, "applied": T.APPLIED, "touching": "".join(T.LOG_BLOCKS["patch"])}


def test_marks_cut_what_the_single_extractions_cut(spark):
    logs = spark.createDataFrame([(k, v) for k, v in _logs().items() if v is not None], "instance_id string, logs string")
    m = T.log_marks("logs")
    for got, want in ((T.marked_block("logs", m, "patch"), T.log_patch("logs")), (T.marked_block("logs", m, "eval"), T.log_eval_output("logs")),
                      (T.marked_block("logs", m, "traj"), T.log_trajectory("logs")), (T.marked_status(m), T.apply_status("logs"))):
        assert logs.filter(~got.eqNullSafe(want)).count() == 0


def test_dispatch_reads_logs_once(spark):
    logs = spark.createDataFrame(list(_logs().items()), "instance_id string, logs string")
    agents = {"a": "preds_json:x", "b": "raw", "c": "preds_json:y", "d": "patch"}
    out = LG.dispatch(logs, agents)
    got = {(r.agent, r.instance_id): (r.model_patch, r.apply_status) for r in out.collect()}
    assert len(got) == 4 * len(_logs())
    assert got["b", "both"][0] == got["d", "both"][0] == "+x" and got["a", "both"] == got["c", "both"] == ("p", "unknown")
    assert got["b", "twice"][0].startswith("first") and got["b", "open"][0] == got["b", "reversed"][0] == got["b", "none"][0] == ""
    assert got["a", "failed"] == ("", "failed") and got["a", "applied"][1] == "applied"
    plan = spark.range(1).select(F.lit("i").alias("instance_id"), F.lit("x").alias("logs"))
    text = LG.dispatch(plan, agents)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Range (") == 1


@pytest.mark.parametrize("agents", [{"a": "raw"}, {"a": "preds_json:x"}])
def test_only_needed_blocks_are_cut(spark, agents):
    logs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("instance_id"), F.col("text").alias("logs"))
    plan = LG.dispatch(logs, agents)._jdf.queryExecution().optimizedPlan().toString()
    assert ("from_json" in plan) == (agents["a"] != "raw")
