"""Run a streaming plan to completion over staged files (availableNow).

Inputs are staged in the shared checkpoint folder (``spark.checkpoint.dir``)
as a sequence of separate file drops, as a live writer would produce them;
the stream reads one drop per micro-batch and writes its sink there too.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import ensure_checkpoint_dir, scratch_path
from ..sources.shared import filesystem, get_json, names, put_whole
from .episodes import new_predictions
from .membership import IdIndex


#: keeps state on disk, with timers and list state (``transformWithState`` needs it)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: seconds between looks at a running query, and reports that Spark keeps between two looks
POLL_SECONDS, PROGRESS_KEPT = 0.25, 1000
#: staged bytes a file of a drop should hold
FILE_BYTES = 64 << 20


def stream_session(spark: SparkSession) -> SparkSession:
    """A sibling session (same SparkContext, own SQL settings) for running a
    stateful stream: its state is split into one partition per core
    (``defaultParallelism``) instead of the generic shuffle default, a
    count fixed at the query's first start and kept in its checkpoint."""
    s = spark.newSession()
    s.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    s.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # a micro-batch saves its changes, not the whole state
    s.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        value = spark.conf.get(key, None)
        if value is not None:
            s.conf.set(key, value)
    return s


def new_area(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def stage_drops(df: DataFrame, folder: str, order_col: str, drops: int = 3, fmt: str = "parquet",
                key: str | None = None, files_per_drop: int = 4, file_bytes: int = FILE_BYTES) -> int:
    """Write ``df`` as ``drops`` successive file drops split at quantiles of
    ``order_col`` (so later drops hold later rows; rows without an order value
    are in the first).  Each drop is written by ``files_per_drop`` tasks, or
    as many as its share of the staged bytes needs at ``file_bytes`` a file,
    hash-partitioned by ``key`` so that one key's rows of a drop sit in one
    file; a stream reading the returned number of files per micro-batch then
    sees every key in order.  The input is written once to ``folder +
    "_src"`` (a table in the shared checkpoint folder) so the quantiles and
    the drops read it instead of recomputing its plan.  Only the split points
    and sizes reach the driver."""
    df.write.mode("overwrite").parquet(folder + "_src")
    df = df.sparkSession.read.parquet(folder + "_src")
    at = F.col(order_col)
    qs = [i / drops for i in range(1, drops)] or [0.5]
    known = df.agg(F.percentile_approx(at, qs, 10000).alias("q"), F.count(F.lit(1)).alias("n"), F.count(at).alias("dated")).first()
    size = df.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size").alias("b")).first()["b"] or 0
    share = (known["n"] - known["dated"] + known["dated"] / drops) / max(1, known["n"])
    files = max(files_per_drop, math.ceil(size * share / file_bytes))
    bounds = [None, *((known["q"] or []) if drops > 1 else []), None]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        part = df
        if lo is not None:
            part = part.filter(at > F.lit(lo))
        if hi is not None:
            part = part.filter((at <= F.lit(hi)) | at.isNull() if lo is None else at <= F.lit(hi))
        part = part.repartition(files, key) if key else part.repartition(files)
        part.write.mode("append").format(fmt).save(folder)
    return files


def _finish(query) -> list[dict]:
    """Wait for the end of a query; every micro-batch's progress report (one
    small dict each), gathered while it runs, as Spark keeps only the last
    few."""
    seen: dict[int, dict] = {}
    done = False
    while not done:
        done = query.awaitTermination(POLL_SECONDS)
        for p in query.recentProgress:
            p = p if isinstance(p, dict) else json.loads(p.json)
            seen[p["batchId"]] = p
    return [seen[b] for b in sorted(seen)]


def run_append(stream: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> list[dict]:
    """Run to completion; returns the per-micro-batch progress reports (e.g.
    for ``late_rows_dropped``)."""
    stream.sparkSession.conf.set("spark.sql.streaming.numRecentProgressUpdates", str(PROGRESS_KEPT))
    return _finish(stream.writeStream.format(fmt).outputMode("append")
                   .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out))


def late_rows_dropped(progress: list[dict]) -> int:
    """Rows that arrived behind the watermark and were dropped by the
    stateful operators, summed over the run's micro-batches."""
    return sum(op.get("numRowsDroppedByWatermark", 0)
               for p in progress for op in p.get("stateOperators", []))


def run_intake(stream: DataFrame, completed, out: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Every epoch reads the completed instances anew (``completed()``) and
    writes what is new to its own folder ``out/epoch=N``, so an id is taken
    once however late it is sent again, and an epoch that is run again after a
    failure replaces its own rows only."""
    schema = StructType([*stream.schema.fields, StructField("epoch", LongType())])
    # an empty first folder, so that there is always a table to read
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").format(fmt).save(f"{out}/epoch=-1")

    def write(batch: DataFrame, epoch: int) -> None:
        taken = batch.sparkSession.read.schema(schema).format(fmt).load(out).filter(F.col("epoch") < epoch)
        new_predictions(batch, completed(), taken).write.mode("overwrite").format(fmt).save(f"{out}/epoch={epoch}")

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def run_indexed_intake(stream: DataFrame, completed: IdIndex, taken: IdIndex, out: str, checkpoint: str,
                       fmt: str = "parquet") -> None:
    """J1 with bounded reads: an epoch asks two indexes (``membership.py``)
    for its own ids instead of reading all that was completed or taken.
    Whoever completes instances adds them to ``completed``.  An epoch that is
    run again after a failure gives the same rows and replaces them."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.filter(F.col("instance_id").isNotNull())
        fields = [c for c in batch.columns if c != "instance_id"]
        one = batch.groupBy("instance_id").agg(F.min(F.struct(*fields)).alias("r")).select("instance_id", "r.*").checkpoint()
        known = completed.seen(one.select("instance_id"), 1 << 62).unionByName(taken.seen(one.select("instance_id"), epoch))
        new = one.join(known, one["instance_id"] == known["id"], "left_anti").checkpoint()
        new.write.mode("overwrite").format(fmt).save(f"{out}/epoch={epoch}")
        taken.add(new.select("instance_id"), epoch)

    ensure_checkpoint_dir(stream.sparkSession)
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").format(fmt).save(f"{out}/epoch=-1")
    _finish(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# -------------------------------------------------------- published snapshots
CURRENT = "_current.json"
#: snapshots that stay beside the current one, for readers that began before it
KEPT_SNAPSHOTS = 2


def publish(df: DataFrame, out: str, version: int) -> None:
    """Write ``df`` as a version of ``out`` and then make it the current one:
    a reader finds the version before or this one, whole, also while it is
    written or after a failure.  A version that is not newer than the current
    one is not published again."""
    fs, base = filesystem(out)
    now = current_version(out)
    if now is not None and version <= now:
        return
    df.write.mode("overwrite").parquet(f"{out}/v={version}")
    put_whole(fs, f"{base}/{CURRENT}", {"version": version})
    old = sorted(int(n[2:]) for n in names(fs, base) if n.startswith("v="))
    for v in [v for v in old if v < version][:-KEPT_SNAPSHOTS]:
        fs.delete_dir(f"{base}/v={v}")


def current_version(out: str) -> int | None:
    """The version that readers of ``out`` find; None before the first."""
    fs, base = filesystem(out)
    try:
        return get_json(fs, f"{base}/{CURRENT}")["version"]
    except FileNotFoundError:
        return None


def read_published(spark: SparkSession, out: str) -> DataFrame:
    """The current version of a published table."""
    version = current_version(out)
    if version is None:
        raise FileNotFoundError(f"nothing is published in {out}")
    return spark.read.parquet(f"{out}/v={version}")


def run_complete(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Complete-mode aggregate: every epoch publishes its own snapshot
    (``publish``, read with ``read_published``)."""
    _finish(stream.writeStream.outputMode("complete").foreachBatch(lambda batch, epoch: publish(batch, out, epoch))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
