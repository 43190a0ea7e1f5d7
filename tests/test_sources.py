"""File sources and sinks on hand-made files."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from rewardlake.sources import files as FS


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_json_array(spark, tmp_dir):
    p = f"{tmp_dir}/problems.json"
    _write(p, json.dumps([{"task_id": "t1", "prompt": "p", "test": "t", "entry_point": "f"},
                          {"task_id": "t2", "prompt": "q", "test": "u", "entry_point": "g"}]))
    rows = FS.read_json_array(spark, p).orderBy("task_id").collect()
    assert [r.task_id for r in rows] == ["t1", "t2"]


def test_prompt_jsonl(spark, tmp_dir):
    p = f"{tmp_dir}/prompts.jsonl"
    lines = [{"instance_id": "a", "text_inputs": "first"}, {"instance_id": "b", "text_inputs": ""},
             {"instance_id": "", "text_inputs": "x"}, {"instance_id": "a", "text_inputs": "second"},
             {"instance_id": "a", "text_inputs": ""}, {"text_inputs": "no id"}]
    _write(p, "\n".join(json.dumps(x) for x in lines[:3]) + "\n\n" + "\n".join(json.dumps(x) for x in lines[3:]) + "\n")
    got = {r.instance_id: r.text_inputs for r in FS.read_prompts(spark, p).collect()}
    assert got == {"a": "second"}
    bad = f"{tmp_dir}/bad.jsonl"
    _write(bad, '{"instance_id": "a", "text_inputs": "x"}\n{not json\n')
    with pytest.raises(Exception):
        FS.read_prompts(spark, bad).collect()


def test_prediction_store(spark, tmp_dir):
    root = f"{tmp_dir}/out"
    _write(f"{root}/dir_a/prediction.json", json.dumps({"instance_id": "real_a", "model_patch": "p"}, indent=2))
    _write(f"{root}/dir_b/prediction.json", "{corrupt")
    _write(f"{root}/dir_c/prediction.json", json.dumps({"model_patch": "no id"}))
    _write(f"{root}/dir_d/deeper/prediction.json", json.dumps({"instance_id": "deep"}))
    _write(f"{root}/predictions.jsonl", "{}")
    ids = sorted(r.instance_id for r in FS.completed_ids(spark, root).collect())
    assert ids == ["real_a"]


def test_logs_wholetext(spark, tmp_dir):
    _write(f"{tmp_dir}/logs/j1.txt", "line1\nline2\n")
    _write(f"{tmp_dir}/logs/j2.txt", "x")
    got = {os.path.basename(r.path): r.logs for r in FS.read_logs(spark, f"{tmp_dir}/logs").collect()}
    assert got == {"j1.txt": "line1\nline2\n", "j2.txt": "x"}


def test_jsonl_and_summary_sinks(spark, tmp_dir):
    df = spark.createDataFrame([(2, "b", None), (1, "a", "p")], "pos long, instance_id string, model_patch string")
    FS.write_jsonl(df, f"{tmp_dir}/preds", order="pos")
    back = spark.read.json(f"{tmp_dir}/preds").orderBy("pos").collect()
    assert [r.instance_id for r in back] == ["a", "b"]
    raw = "".join(open(os.path.join(f"{tmp_dir}/preds", f)).read()
                  for f in sorted(os.listdir(f"{tmp_dir}/preds")) if f.endswith(".json"))
    assert '"model_patch":null' in raw
    FS.write_summary(df.agg(F.count("*").alias("total")), f"{tmp_dir}/summary")
    parts = [f for f in os.listdir(f"{tmp_dir}/summary") if f.endswith(".json")]
    assert len(parts) == 1


def test_manifest_and_text_list(spark, tmp_dir):
    root = f"{tmp_dir}/run"
    _write(f"{root}/predictions.jsonl", "{}")
    _write(f"{root}/results.json", "{}")
    _write(f"{root}/i1/prediction.json", "{}")
    _write(f"{root}/i1/sub/traj.json", "[]")
    keys = sorted(r.key for r in FS.artifact_manifest(spark, root, "s3://b/run1/").collect())
    assert keys == ["s3://b/run1/i1/prediction.json", "s3://b/run1/i1/sub/traj.json"]
    imgs = spark.createDataFrame([("b:latest",), ("a:latest",)], "image string")
    FS.write_text_list(imgs, "image", f"{tmp_dir}/list")
    txt = "".join(open(os.path.join(f"{tmp_dir}/list", f)).read()
                  for f in sorted(os.listdir(f"{tmp_dir}/list")) if f.startswith("part"))
    assert txt.split() == ["a:latest", "b:latest"]


def test_artifact_tables(spark, tmp_dir):
    from rewardlake.functions.text import TRAJ_END, TRAJ_START
    res = spark.createDataFrame([("a", None, True, True), ("b", "boom", False, None)],
                                "instance_id string, error string, patch_exists boolean, resolved boolean")
    preds = spark.createDataFrame([("a", "p", "m"), ("b", "", "m")],
                                  "instance_id string, model_patch string, model_name_or_path string")
    logs = spark.createDataFrame([("a", f"x {TRAJ_START}[1]{TRAJ_END}"), ("b", "")], "instance_id string, logs string")
    FS.write_artifacts(res, preds, logs, f"{tmp_dir}/art", "run-1")
    rd = lambda t: {r.instance_id: r for r in spark.read.parquet(f"{tmp_dir}/art/{t}").collect()}
    assert set(rd("predictions")) == {"a", "b"} and rd("predictions")["a"].run_id == "run-1"
    reports = rd("reports")
    assert json.loads(reports["a"].report) == {"resolved": True, "patch_exists": True}
    assert json.loads(reports["b"].report) == {"error": "boom"}
    assert set(rd("pod_logs")) == {"a"}
    assert rd("trajectories")["a"].trajectory == "[1]"
    assert os.path.isdir(f"{tmp_dir}/art/reports/run_id=run-1")


def test_files_added_later_are_read(spark, tmp_dir):
    from rewardlake.sources.tables import table

    spark.range(5).write.parquet(f"{tmp_dir}/region.parquet")
    assert table(spark, tmp_dir, "region").count() == 5
    spark.range(5).write.mode("append").parquet(f"{tmp_dir}/region.parquet")
    assert table(spark, tmp_dir, "region").count() == 10


def test_last_prompt_wins_over_files_of_unequal_size(spark, tmp_dir):
    import json

    from rewardlake.sources.files import read_prompts

    with open(f"{tmp_dir}/a.jsonl", "w") as f:
        f.write(json.dumps({"instance_id": "x", "text_inputs": "old"}) + "\n")
    with open(f"{tmp_dir}/b.jsonl", "w") as f:
        f.write(json.dumps({"instance_id": "x", "text_inputs": "new"}) + "\n")
        f.writelines(json.dumps({"instance_id": f"y{i}", "text_inputs": "z" * 500}) + "\n" for i in range(400))
    got = {r.instance_id: r.text_inputs for r in read_prompts(spark, tmp_dir).collect()}
    assert got["x"] == "new" and len(got) == 401


def test_manifest_root_is_literal(spark, tmp_dir):
    import os

    from rewardlake.sources.files import artifact_manifest

    root = f"{tmp_dir}/run+(1)"
    os.makedirs(f"{root}/inst")
    for p in ("top.json", "inst/log.txt"):
        with open(f"{root}/{p}", "w") as f:
            f.write("x")
    for given in (root, "file:" + root + "/"):
        [r] = artifact_manifest(spark, given, "pre").collect()
        assert (r.key, r.rel) == ("pre/inst/log.txt", "inst/log.txt")


def test_no_local_scratch_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from rewardlake.session import ensure_checkpoint_dir

    sc = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))


def test_artifacts_written_again_replace_those_of_the_run(spark, tmp_dir):
    from rewardlake.operators.dialog import multi_turn_record, unnest_record

    res = spark.createDataFrame([("a", None, True, True)], "instance_id string, error string, patch_exists boolean, resolved boolean")
    preds = spark.createDataFrame([("a", "p", "m")], "instance_id string, model_patch string, model_name_or_path string")
    turns = spark.createDataFrame([("a", 0, "x", False, 0.25), ("a", 1, "y", True, 1.0), ("a", 2, "z", False, 0.0), (None, 0, "n", False, 0.5)],
                                  "instance_id string, turn int, output string, all_passed boolean, aggregate_score double")
    checks = spark.createDataFrame([("a", 0, 1, "size", "ok", 0.25, 0.5), ("a", 0, 0, "form", "timeout", 0.0, 0.5), ("a", 1, 0, "form", "ok", 1.0, 0.5)],
                                   "instance_id string, turn int, ord int, name string, status string, score double, pass_threshold double")
    record = multi_turn_record(turns, checks, 3)
    for run in ("run-1", "run-1", "run-2"):
        FS.write_artifacts(res, preds, None, f"{tmp_dir}/again", run, record)
    stored = spark.read.parquet(f"{tmp_dir}/again/multi_turn")
    assert sorted(r.run_id for r in stored.where("instance_id = 'a'").collect()) == ["run-1", "run-2"]
    assert spark.read.parquet(f"{tmp_dir}/again/predictions").count() == 2
    run = json.loads(stored.where("instance_id = 'a' and run_id = 'run-1'").first().multi_turn)
    assert run["num_turns"] == 2 and run["stopped_early"] and run["final_aggregate_score"] == 1.0
    first, last = run["turns"]
    assert [v["name"] for v in first["verifier_results"]] == ["form", "size"]
    assert "[form] TIMEOUT\n[size] FAILED (score: 0.25)" in first["feedback"] and last["feedback"] is None
    flat = unnest_record(record).collect()
    assert sorted((str(r.instance_id), r.turn, str(r.name)) for r in flat) == [
        ("None", 0, "None"), ("a", 0, "form"), ("a", 0, "size"), ("a", 1, "form")]


def test_a_rerun_without_rows_of_a_kind_leaves_none(spark, tmp_dir):
    res = spark.createDataFrame([("a", None, True, True)], "instance_id string, error string, patch_exists boolean, resolved boolean")
    preds = spark.createDataFrame([("a", "p", "m")], "instance_id string, model_patch string, model_name_or_path string")
    logs = spark.createDataFrame([("a", "some text")], "instance_id string, logs string")
    root = f"{tmp_dir}/rerun"
    for run in ("run=1/x", "run-2"):
        FS.write_artifacts(res, preds, logs, root, run)
    FS.write_artifacts(res, preds, logs.withColumn("logs", F.lit("")), root, "run=1/x")
    assert [r.run_id for r in spark.read.parquet(f"{root}/pod_logs").collect()] == ["run-2"]
    assert sorted(r.run_id for r in spark.read.parquet(f"{root}/predictions").collect()) == ["run-2", "run=1/x"]


def test_a_batch_with_a_broken_line_is_lost_whole(spark, tmp_dir):
    from rewardlake.operators import joins as J

    lines = {"1": ['{"instance_id": "a", "error": null, "resolved": true}', '{"instance_id": "b", "error": "x", "resolved": null}'],
             "2": ['{"instance_id": "c", "error": null, "resolved": true}', '{"instance_id": "d", "err'], "w-3": ["not json"],
             "4": ['{"instance_id": "e"}'], "5": []}
    for batch, rows in lines.items():
        os.makedirs(f"{tmp_dir}/b/batch={batch}")
        with open(f"{tmp_dir}/b/batch={batch}/part.json", "w") as f:
            f.writelines(f"{r}\n" for r in rows)
    whole, lost = FS.read_batches(spark, f"{tmp_dir}/b", "instance_id string, error string, resolved boolean")
    assert sorted((r.batch, r.broken) for r in lost.collect()) == [("2", 1), ("w-3", 1)]
    tasks = spark.createDataFrame([(i,) for i in "abcdef"], "instance_id string")
    got = {r.instance_id: (r.batch, r.returned, r.error, r.resolved) for r in J.returned_or_error(tasks, whole).collect()}
    gone = (None, False, "Worker batch failed", False)
    assert got == {"a": ("1", True, None, True), "b": ("1", True, "x", None), "c": gone, "d": gone, "e": ("4", True, None, None), "f": gone}


def test_a_table_written_anew_has_its_new_schema(spark, tmp_dir):
    from rewardlake.sources.tables import table

    spark.range(3).write.parquet(f"{tmp_dir}/region.parquet")
    assert table(spark, tmp_dir, "region").columns == ["id"] and table(spark, tmp_dir, "region").count() == 3
    spark.range(4).selectExpr("id as a", "'x' as b").write.mode("overwrite").parquet(f"{tmp_dir}/region.parquet")
    assert table(spark, tmp_dir, "region").columns == ["a", "b"] and table(spark, tmp_dir, "region").count() == 4


def _many(root):
    """A tree of small files with odd names, hidden and empty ones."""
    for i in range(40):
        _write(f"{root}/inst {i}%20é+[1]/log.txt", f"log {i}\n" * (i % 3))
    _write(f"{root}/top.txt", "top")
    _write(f"{root}/_SUCCESS", "x")
    _write(f"{root}/a/.hidden.txt", "x")
    _write(f"{root}/a/_part", "x")
    _write(f"{root}/a/k1/in.txt", "xx")
    _write(f"{root}/b/c/d/e/deep.txt", "xyz")
    _write(f"{root}/b/_c/d/hidden.txt", "xyz")
    _write(f"{root}/.b/hidden.txt", "xyz")


def test_manifest_of_many_folders_is_listed_in_tasks(spark, tmp_dir):
    root = f"{tmp_dir}/run (2)"
    _many(root)
    m = FS.artifact_manifest(spark, root, "p")
    assert m.inputFiles() == []                          # the driver holds none of the tree
    # what Spark's own source lists
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length").collect()
    whole = {r.path.removeprefix(f"file:{root}/"): r.length for r in listed}
    got = {r.rel: r.length for r in m.collect()}
    assert got == {k: n for k, n in whole.items() if "/" in k} and got["b/c/d/e/deep.txt"] == 3 and len(got) == 28


def test_folders_of_lines(spark, tmp_dir):
    from rewardlake.sources.listing import write_lines

    rows = spark.createDataFrame([("k=a", "1"), ("k=b", None), ("k=a", "2é"), ("k=c", "")], "folder string, value string").coalesce(1)
    assert write_lines(rows, f"file://{tmp_dir}/out", "log.txt") == 3
    found = {f: open(f"{tmp_dir}/out/{f}/log.txt").read() for f in ("k=a", "k=b", "k=c")}
    assert found == {"k=a": "1\n2é\n", "k=b": "\n", "k=c": "\n"}
    assert write_lines(rows.limit(0), f"{tmp_dir}/none", "log.txt") == 0 and os.path.isdir(f"{tmp_dir}/none")


def test_logs_of_many_folders_are_read_in_tasks(spark, tmp_dir):
    import gzip

    root = f"{tmp_dir}/run (2)"
    _many(root)
    with gzip.open(f"{root}/a/z.gz", "wb") as f:
        f.write(b"zipped\n" * 3)
    parted = f"{tmp_dir}/parted"
    for k in range(3):
        _write(f"{parted}/k={k}/in.txt", f"{k}")
    for path in (parted, f"{root}/*", f"file:{root}/inst*/log.txt", f"{root}/*/?og.txt", f"{root}/top.txt", f"{root}/b/c/d/e/", root,
                 f"{root}/[ab]*"):
        rows = FS.read_logs(spark, path)
        assert "[" in path or rows.inputFiles() == []    # the driver holds none of the tree
        own = spark.read.text(path, wholetext=True).select("_metadata.file_path", "value")
        got = sorted(map(tuple, rows.collect()))
        assert got == sorted(map(tuple, own.collect())) and got, path
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        FS.read_logs(spark, f"{root}/none*").collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        FS.read_logs(spark, f"{root}/none").collect()


def test_log_bytes_are_kept(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/logs/a")
    with open(f"{tmp_dir}/logs/a/log.txt", "wb") as f:
        f.write(b"\xff\x00\r\n\xc3")
    [r] = FS.read_logs(spark, f"{tmp_dir}/logs/*").select(F.hex(F.col("logs").cast("binary")).alias("h")).collect()
    assert r.h == "FF000D0AC3"


@pytest.mark.parametrize("form, end", [("gzip", "gz"), ("bzip2", "bz2"), ("deflate", "deflate"), ("snappy", "snappy")])
def test_compressed_logs(spark, tmp_dir, form, end):
    spark.createDataFrame([("log",)], "value string").coalesce(1).write.option("compression", form).text(f"{tmp_dir}/c")
    [r] = FS.read_logs(spark, f"{tmp_dir}/c/*.{end}").collect()
    assert r.logs == "log\n"
