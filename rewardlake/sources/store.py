"""Prediction stores of many small files.

A store is ``<root>/<instance folder>/prediction.json``, one level deep.
Spark's file sources would list all of it on the driver.  Here a Python data
source lists the folders in a task, in batches; the listing, a table of paths,
is dealt over tasks that open the files.  As a stream, the store is read by
modification time: the offset is a time, an epoch opens the files changed
since the last one, and the driver lists nothing.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..session import ensure_checkpoint_dir
from .shared import filesystem

LISTING, STORE = "folder_listing", "prediction_store"
FILE = "prediction.json"
#: names listed or files read for one Arrow batch, files of a reading task
BATCH, FILES = 2000, 2000

_LISTED = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified_ms", pa.int64())])
PREDICTIONS = "instance_id string, model_patch string, model_name_or_path string, source_file string"
_PREDICTED = pa.schema([(n, pa.string()) for n in ("instance_id", "model_patch", "model_name_or_path", "source_file")])


def _folders(fs: pafs.FileSystem, root: str, prefix: str) -> Iterator[str]:
    """Folders of ``root`` whose name starts with ``prefix``.  A local folder
    (or a mounted one) is listed piece by piece; other stores give the
    listing whole to the task."""
    if isinstance(fs, pafs.LocalFileSystem):
        if not os.path.isdir(root):
            return
        with os.scandir(root) as entries:
            for e in entries:
                if e.name.startswith(prefix) and e.is_dir():
                    yield e.path
        return
    for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if i.type == pafs.FileType.Directory and i.base_name.startswith(prefix):
            yield i.path


def listed(root: str, prefix: str = "", file: str = FILE, after_ms: int | None = None,
           until_ms: int | None = None) -> Iterator[list[tuple[str, int, int]]]:
    """``(path, size, modified)`` of ``<root>/<prefix...>/<file>``, in batches;
    only files modified after ``after_ms`` and not after ``until_ms``."""
    fs, root = filesystem(root)
    wait: list[str] = []

    def look() -> list[tuple[str, int, int]]:
        out = []
        for i in fs.get_file_info(wait):
            if i.type != pafs.FileType.File:
                continue
            at = (i.mtime_ns or 0) // 1_000_000
            if (after_ms is None or at > after_ms) and (until_ms is None or at <= until_ms):
                out.append((i.path, i.size, at))
        wait.clear()
        return out

    for folder in _folders(fs, root, prefix):
        wait.append(f"{folder}/{file}")
        if len(wait) == BATCH:
            yield look()
    if wait:
        yield look()


def parse_prediction(data: bytes) -> tuple | None:
    """The fields of a stored prediction; None if it is no JSON object with
    an ``instance_id``."""
    try:
        record = json.loads(data)
    except ValueError:
        return None
    if not isinstance(record, dict) or record.get("instance_id") is None:
        return None
    fields = (record.get(n) for n in ("instance_id", "model_patch", "model_name_or_path"))
    return tuple(v if v is None or isinstance(v, str) else json.dumps(v) for v in fields)


def read_files(root: str, paths: list[str]) -> pa.RecordBatch:
    """Predictions of the files that can be read and parsed."""
    fs, _ = filesystem(root)
    rows = []
    for path in paths:
        try:
            with fs.open_input_stream(path) as f:
                got = parse_prediction(f.read())
        except OSError:
            continue
        if got:
            rows.append((*got, path))
    cols = list(zip(*rows, strict=True)) or [()] * len(_PREDICTED)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], schema=_PREDICTED)


@dataclass
class Prefix(InputPartition):
    """Folders whose name starts with ``prefix``, and a span of time."""
    prefix: str
    after_ms: int | None = None
    until_ms: int | None = None


class _ListingReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.file = options["path"], options.get("file", FILE)
        self.prefixes = json.loads(options.get("prefixes", '[""]'))

    def partitions(self):
        return [Prefix(p) for p in self.prefixes]

    def read(self, partition: Prefix) -> Iterator[pa.RecordBatch]:
        for rows in listed(self.root, partition.prefix, self.file):
            cols = list(zip(*rows, strict=True)) or [()] * len(_LISTED)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _LISTED, strict=True)], schema=_LISTED)


class FolderListing(DataSource):
    """``path``: the root; ``file``: the file looked for in every folder;
    ``prefixes``: JSON list of folder-name prefixes, a task each."""

    @classmethod
    def name(cls) -> str:
        return LISTING

    def schema(self) -> str:
        return "path string, size bigint, modified_ms bigint"

    def reader(self, schema):
        return _ListingReader(self.options)


class _StoreStream(DataSourceStreamReader):
    """Offsets are times in milliseconds.  Files are taken once they are
    ``settle_ms`` old, so that none of an epoch's time can still turn up."""

    def __init__(self, options):
        self.root = options["path"]
        self.prefixes = json.loads(options.get("prefixes", '[""]'))
        self.settle = int(options.get("settle_ms", 60_000))
        self.last = -1

    def initialOffset(self) -> dict:
        return {"until_ms": -1}

    def latestOffset(self) -> dict:
        # the clock may go back, an offset may not
        self.last = max(self.last, int(time.time() * 1000) - max(1, self.settle))
        return {"until_ms": self.last}

    def partitions(self, start: dict, end: dict):
        return [Prefix(p, start["until_ms"], end["until_ms"]) for p in self.prefixes]

    def read(self, partition: Prefix) -> Iterator[pa.RecordBatch]:
        for rows in listed(self.root, partition.prefix, FILE, partition.after_ms, partition.until_ms):
            if rows:
                yield read_files(self.root, [r[0] for r in rows])

    def commit(self, end: dict) -> None:
        pass


class PredictionStore(DataSource):
    """The store as a stream; options as in ``FolderListing``, and
    ``settle_ms``."""

    @classmethod
    def name(cls) -> str:
        return STORE

    def schema(self) -> str:
        return PREDICTIONS

    def streamReader(self, schema):
        return _StoreStream(self.options)


def list_store(spark: SparkSession, root: str, prefixes: tuple[str, ...] = ("",), file: str = FILE) -> DataFrame:
    """``path, size, modified_ms`` of every folder's ``file``."""
    spark.dataSource.register(FolderListing)
    return spark.read.format(LISTING).option("file", file).option("prefixes", json.dumps(list(prefixes))).load(root)


def read_store(spark: SparkSession, root: str, prefixes: tuple[str, ...] = ("",), files: int = FILES) -> DataFrame:
    """A4: the predictions of a store.  Corrupt files, records without an
    id and unreadable files are skipped; the id comes from the file, not from
    its folder.  The listing is kept by a checkpoint and dealt over tasks of
    ``files`` files; a store that does not exist is empty."""
    ensure_checkpoint_dir(spark)
    found = list_store(spark, root, prefixes).select("path").checkpoint()
    tasks = max(1, -(-found.count() // files), min(spark.sparkContext.defaultParallelism, found.count()))

    def read(batches):
        for batch in batches:
            paths = batch.column("path").to_pylist()
            for s in range(0, len(paths), BATCH):
                yield read_files(root, paths[s:s + BATCH])

    return found.repartition(tasks).mapInArrow(read, PREDICTIONS)


def stream_store(spark: SparkSession, root: str, prefixes: tuple[str, ...] = ("",), settle_ms: int = 60_000) -> DataFrame:
    """The store as a stream of predictions; a file that is written again
    comes again."""
    spark.dataSource.register(PredictionStore)
    return (spark.readStream.format(STORE).option("prefixes", json.dumps(list(prefixes)))
            .option("settle_ms", str(settle_ms)).load(root))


def write_store(predictions: DataFrame, root: str) -> int:
    """Write ``(folder, file, content)`` rows as ``<root>/<folder>/<file>``
    (names of their own, which Spark's writers do not give); the number of
    files.  For stores that other programs read; A8 tables are the better
    form."""
    from .shared import put

    def write(batches):
        fs, base = filesystem(root)
        for batch in batches:
            for folder, file, content in zip(*(batch.column(c).to_pylist() for c in ("folder", "file", "content")), strict=True):
                put(fs, f"{base}/{folder}/{file}", content.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return predictions.select("folder", "file", "content").mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


# the sources' classes travel with their tasks (see shipping.py)
from ..shipping import ship_by_value  # noqa: E402

ship_by_value(__name__)
