"""File sources and sinks of a run's artifacts.

Everything is a Spark reader or writer on a path (local, HDFS or object
store URI alike), but for trees of many small files (A6, A10), which tasks
list and open (``listing.py``); nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import last_wins
from ..functions.text import truthy
from .listing import found_files, read_found

PROBLEM_SCHEMA = "task_id string, prompt string, test string, entry_point string"
PROMPT_SCHEMA = "instance_id string, text_inputs string"
PREDICTION_SCHEMA = "instance_id string, model_patch string, model_name_or_path string"
CORRUPT = "_corrupt_record"


def read_json_array(spark: SparkSession, path: str, schema: str = PROBLEM_SCHEMA) -> DataFrame:
    """A2: a file holding one JSON list; every element becomes a row."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """A3: prompt JSONL.  Blank lines are skipped, a malformed line fails the
    read (FAILFAST), records without an id or text are dropped and the last
    record per id wins: files by path, lines by position."""
    raw = (spark.read.schema(PROMPT_SCHEMA).option("mode", "FAILFAST").json(path)
           .withColumn("pos", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                                       F.monotonically_increasing_id().alias("line"))))
    kept = raw.filter(truthy(F.col("instance_id")) & truthy(F.col("text_inputs")))
    return last_wins(kept.select("instance_id", "pos", "text_inputs"), "instance_id", "pos")


def read_prediction_store(spark: SparkSession, root: str) -> DataFrame:
    """A4: ``<root>/<instance dir>/prediction.json`` one level deep.  Corrupt
    files and records without ``instance_id`` are skipped; the id comes from
    the file content, not the folder name."""
    schema = f"{PREDICTION_SCHEMA}, {CORRUPT} string"
    df = (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT)
          .json(f"{root.rstrip('/')}/*/prediction.json"))
    return (df.filter(F.col(CORRUPT).isNull() & F.col("instance_id").isNotNull())
            .select("instance_id", "model_patch", "model_name_or_path",
                    F.col("_metadata.file_path").alias("source_file")))


def completed_ids(spark: SparkSession, root: str) -> DataFrame:
    """A4 + C1: ids that already have a stored prediction."""
    return read_prediction_store(spark, root).select("instance_id").distinct()


def read_batches(spark: SparkSession, root: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """the results that worker batches left as JSON lines in
    ``<root>/batch=<id>/``, as one table with ``batch``, and the lost batches
    ``(batch, broken)``.  A batch that holds a line that is no record of
    ``schema`` (cut off, not JSON) is lost whole: none of its rows count."""
    lines = spark.read.schema("value string, batch string").text(root).filter(F.btrim("value") != "")
    record = F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = lines.select("batch", record.alias("r"))
    broken = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    lost = rows.groupBy("batch").agg(F.count_if(broken).alias("broken")).filter(F.col("broken") > 0)
    whole = rows.join(lost.select("batch"), "batch", "left_anti").select("r.*", "batch").drop(CORRUPT)
    return whole, lost


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log file with its whole text.  ``path`` is a file, a
    folder or a pattern; tasks list and read it.  What they cannot open, and
    patterns of more than ``*`` and ``?``, Spark's text source reads."""
    found = found_files(spark, path, enter=lambda name: "=" in name)
    if found is not None:
        return read_found(*found).select("path", F.col("content").cast("string").alias("logs"))
    return (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("logs")))


def write_jsonl(df: DataFrame, path: str, order: str | None = None) -> None:
    """JSON lines, nulls written as ``null`` (not dropped); sorted by
    ``order`` when the consumer needs dataset order."""
    out = df.orderBy(order) if order else df
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """The one-row run summary as a single JSON file (the input is an
    aggregate, so one task is enough)."""
    summary.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def artifact_manifest(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """A10: files below an instance sub-directory (any depth), skipping the
    top-level bulk files, with their object-store key ``prefix/<relative
    path>``.  Only path and length are read, never the content.  Tasks list
    the tree; Spark's binary source lists what they cannot open."""
    found = found_files(spark, root, enter=lambda name: True)
    if found is not None:
        files = found[0].select(F.expr("substring(rel, 2)").alias("rel"), F.col("size").alias("length"))
    else:
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        whole = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
        # what follows the qualified root and its slash
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
                 .select(F.expr(f"substring(path, {len(whole) + 2})").alias("rel"), "length"))
    return (files.filter(F.instr(F.col("rel"), "/") > 0)
            .select(F.concat(F.lit(prefix.rstrip("/") + "/"), F.col("rel")).alias("key"), "rel", "length"))


def write_text_list(df: DataFrame, column: str, path: str) -> None:
    """One value per line, sorted."""
    df.select(column).orderBy(column).write.mode("overwrite").text(path)


def write_artifacts(results: DataFrame, predictions: DataFrame, logs: DataFrame | None, root: str,
                    run_id: str, records: DataFrame | None = None) -> None:
    """A run's per-instance artifacts as one table per kind, partitioned
    by ``run_id`` (never one folder per instance):

    * ``predictions``  -- every instance's prediction
    * ``reports``      -- the eval report as JSON, or ``{"error": ...}`` when
      there is none
    * ``pod_logs``     -- only instances with non-empty logs
    * ``trajectories`` -- only logs that carry a non-empty trajectory block
    * ``multi_turn``   -- where given, each run's nested record as JSON

    A run id written again replaces that run's rows of every kind written,
    also by none.
    """
    from ..functions.text import log_trajectory
    spark = results.sparkSession
    folder = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run_id)

    def write(kind: str, rows: DataFrame) -> None:
        # into the run's own partition, which also an empty table replaces
        rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{kind}/run_id={folder}")

    write("predictions", predictions.select("instance_id", "model_patch", "model_name_or_path"))
    report = F.when(F.col("resolved").isNotNull(),
                    F.to_json(F.struct("resolved", "patch_exists"))
                    ).otherwise(F.to_json(F.struct(F.col("error").alias("error")), {"ignoreNullFields": "false"}))
    write("reports", results.select("instance_id", report.alias("report")))
    if logs is not None:
        kept = logs.join(results.select("instance_id"), "instance_id", "left_semi")
        write("pod_logs", kept.filter(F.col("logs").isNotNull() & (F.col("logs") != "")).select("instance_id", "logs"))
        traj = log_trajectory(F.col("logs"))
        write("trajectories", kept.select("instance_id", traj.alias("trajectory")).filter(F.col("trajectory") != ""))
    if records is not None:
        nested = F.to_json(F.struct(*[c for c in records.columns if c != "instance_id"]), {"ignoreNullFields": "false"})
        write("multi_turn", records.select("instance_id", nested.alias("multi_turn")))
