"""Experiment tracking as a sink with two-phase commit.

A tracking store holds long rows ``(run_id, kind, key, num_value,
str_value)``.  Writing rows of a run replaces what the store had of that run.
Tasks write Parquet files into a folder of the job's own; the commit is one
small file that names them, so a reader sees a job whole or not at all, and a
job that fails leaves nothing.  A run's rows are those of the latest commit
that holds any of them.

``<root>/_data/<job>/*.parquet``, ``<root>/_commits/<time>-<job>.json``,
``<root>/_failures/<time>-<id>.json``.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from ..operators.joins import join_back
from .shared import filesystem, get_json, names, put_whole

FORMAT = "run_tracking"
ROWS = "run_id string, kind string, key string, num_value double, str_value string"
_ARROW = pa.schema([("run_id", pa.string()), ("kind", pa.string()), ("key", pa.string()),
                    ("num_value", pa.float64()), ("str_value", pa.string())])
KINDS = ("param", "metric")


@dataclass
class Written(WriterCommitMessage):
    """What a task tells the commit."""
    file: str | None
    rows: int


@dataclass
class Part(InputPartition):
    """A data file and the number of the commit that names it."""
    file: str
    commit: int


class TrackingWriter(DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.root)
        file, out, rows = f"_data/{self.job}/{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                for col in ("run_id", "kind", "key"):
                    if batch.column(col).null_count:
                        raise ValueError(f"a row to track has no {col}")
                if not pc.all(pc.is_in(batch.column("kind"), pa.array(KINDS))).as_py() and batch.num_rows:
                    raise ValueError(f"a row's kind is none of {', '.join(KINDS)}")
                if out is None:
                    fs.create_dir(f"{root}/_data/{self.job}", recursive=True)
                    out = pq.ParquetWriter(f"{root}/{file}", _ARROW, filesystem=fs)
                out.write_batch(batch.select(_ARROW.names).cast(_ARROW))
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(file if out is not None else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.root)
        done = [m for m in messages if m is not None and m.file]
        # a clock that stands still or goes back must not put this commit before an earlier one
        last = max((int(n.split("-")[0]) for n in names(fs, f"{root}/_commits")), default=0)
        at = max(time.time_ns(), last + 1)
        put_whole(fs, f"{root}/_commits/{at:020d}-{self.job}.json",
                  {"job": self.job, "whole": self.overwrite, "files": [m.file for m in done], "rows": sum(m.rows for m in done)})

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.root)
        try:
            fs.delete_dir(f"{root}/_data/{self.job}")
        except FileNotFoundError:
            pass


def _commits(root: str) -> list[dict]:
    """The store's commits in order, from the last one that replaced all."""
    fs, root = filesystem(root)
    found = [get_json(fs, f"{root}/_commits/{n}") for n in names(fs, f"{root}/_commits")]
    start = max((i for i, c in enumerate(found) if c["whole"]), default=0)
    return found[start:]


class TrackingReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Part]:
        found = [Part(f, i) for i, c in enumerate(_commits(self.root)) for f in c["files"]]
        return found or [Part("", 0)]      # Spark wants one partition at least

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, root = filesystem(self.root)
        for batch in pq.ParquetFile(f"{root}/{partition.file}", filesystem=fs).iter_batches(columns=_ARROW.names):
            n = pa.array([partition.commit] * batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.cast(_ARROW).columns, n], [*_ARROW.names, "commit"])


class TrackingSource(DataSource):
    """``spark.read/write.format("run_tracking")``, ``path`` names the store."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"{ROWS}, commit bigint"

    def reader(self, schema) -> TrackingReader:
        return TrackingReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> TrackingWriter:
        return TrackingWriter(self.options["path"], overwrite)


def write_runs(rows: DataFrame, root: str, mode: str = "append") -> None:
    """Replace the runs in ``rows`` (``overwrite``: the whole store).  A row
    without run, kind or key fails the write, which then leaves nothing."""
    rows.sparkSession.dataSource.register(TrackingSource)
    # a run's rows as the store holds them; the commit number is the store's own
    rows.select(*_ARROW.names).write.format(FORMAT).mode(mode).save(root)


def track(rows: DataFrame, root: str) -> bool:
    """``write_runs`` that never ends the job: a failure is recorded in
    the store (or, if that fails too, only logged) and gives False."""
    try:
        write_runs(rows, root)
        return True
    except Exception as exc:  # noqa: BLE001 - tracking must not end a run
        record = {"type": type(exc).__name__, "message": str(exc)[:2000], "at": time.time()}
        logging.getLogger(__name__).warning("tracking failed (the run goes on): %s", record["message"][:200])
        try:
            fs, base = filesystem(root)
            put_whole(fs, f"{base}/_failures/{time.time_ns():020d}-{uuid.uuid4().hex}.json", record)
        except Exception:  # noqa: BLE001
            logging.getLogger(__name__).warning("the failure could not be recorded in %s", root)
        return False


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The present rows of all runs."""
    spark.dataSource.register(TrackingSource)
    rows = spark.read.format(FORMAT).load(root)
    latest = rows.groupBy("run_id").agg(F.max("commit").alias("_latest"))
    return join_back(rows, latest, "run_id").filter(F.col("commit") == F.col("_latest")).select(*_ARROW.names)


def failures(spark: SparkSession, root: str) -> DataFrame:
    """Recorded failures: ``type, message, at``."""
    fs, base = filesystem(root)
    rows = [get_json(fs, f"{base}/_failures/{n}") for n in names(fs, f"{base}/_failures")]
    return spark.createDataFrame([(r["type"], r["message"], r["at"]) for r in rows], "type string, message string, at double")


def compact(spark: SparkSession, root: str) -> None:
    """One commit with the present rows, then drop the data of commits that
    it replaced.  Not beside other writers or readers of the store."""
    write_runs(read_runs(spark, root), root, "overwrite")
    fs, base = filesystem(root)
    live = {c["job"] for c in _commits(root)}
    for n in names(fs, f"{base}/_commits"):
        if n.split("-")[1].removesuffix(".json") not in live:
            fs.delete_file(f"{base}/_commits/{n}")
    for job in names(fs, f"{base}/_data"):
        if job not in live:
            fs.delete_dir(f"{base}/_data/{job}")


# the source's classes travel with their tasks (see shipping.py)
from ..shipping import ship_by_value  # noqa: E402

ship_by_value(__name__)
