"""Trees of many small files, listed and read in tasks.

Spark's file sources look at every folder of a pattern on the driver, one
after the other.  Here a task lists a folder piece by piece, what it holds is
dealt over all tasks, and they list the folders below and read the files.
What counts as a file is what Spark's sources take: no hidden name, not empty.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, put

#: rows, and bytes of file content, of one Arrow batch
BATCH, BYTES = 2000, 8 << 20
#: levels of a tree whose folders are dealt over the tasks; what lies deeper is listed by the task that holds its folder
LEVELS = 2

FOUND = "rel string, size bigint, folder boolean"
_FOUND = pa.schema([("rel", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())])
_READ = pa.schema([("path", pa.string()), ("content", pa.binary())])
#: what a path's URI writes as %XX
_QUOTED = re.compile(r"[\x00-\x20\"#%<>?\[\\\]^`{|}\x7f-\xa0  -     　]")
#: compressed forms of Hadoop's own, which only Spark's reader opens
_FOREIGN = (".snappy", ".lz4")

Row = tuple[str, int, bool]


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(fs: pafs.FileSystem, folder: str) -> Iterator[Row]:
    """Name, size and kind of what a folder holds.  A local (or mounted)
    folder is listed piece by piece."""
    if not isinstance(fs, pafs.LocalFileSystem):
        for i in fs.get_file_info(pafs.FileSelector(folder)):
            yield i.base_name, i.size or 0, i.type == pafs.FileType.Directory
        return
    with os.scandir(folder) as entries:
        for e in entries:
            try:
                sub = e.is_dir()
                yield e.name, 0 if sub else e.stat().st_size, sub
            except FileNotFoundError:       # a link to nothing
                continue


def _matching(pattern: str) -> Callable[..., Iterator[Row]]:
    """What a folder holds under names of a pattern of ``*`` and ``?``."""
    fits = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern), re.S).fullmatch

    def look(fs, base, rel, _, folder):
        return ((f"{rel}/{n}", size, sub) for n, size, sub in _entries(fs, base + rel) if fits(n)) if folder else ()

    return look


def _named(name: str) -> Callable[..., Iterator[Row]]:
    """The file or folder of one name."""
    def look(fs, base, rel, _, folder):
        [i] = fs.get_file_info([f"{base}{rel}/{name}"])
        if folder and i.type != pafs.FileType.NotFound:
            yield f"{rel}/{name}", i.size or 0, i.type == pafs.FileType.Directory

    return look


def _opened(enter: Callable[[str], bool]) -> Callable[..., Iterator[Row]]:
    """A file as it is; of a folder, its files and the folders to enter."""
    def look(fs, base, rel, size, folder):
        if not folder:
            yield rel, size, folder
            return
        for name, n, sub in _entries(fs, base + rel):
            if not _hidden(name) and (not sub or enter(name)):
                yield f"{rel}/{name}", n, sub

    return look


def _files(enter: Callable[[str], bool]) -> Callable[..., Iterator[Row]]:
    """The files of a folder at any depth."""
    step = _opened(enter)

    def look(fs, base, rel, size, folder):
        wait = [(rel, size, folder)]
        while wait:
            row = wait.pop()
            if row[2]:
                wait += step(fs, base, *row)
            elif row[1] and not _hidden((base + row[0]).rsplit("/", 1)[-1]):
                yield row

    return look


def _looked(found: DataFrame, root: str, look: Callable[..., Iterator[Row]]) -> DataFrame:
    def batch(rows: list[Row]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(_FOUND)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND, strict=True)], schema=_FOUND)

    def run(batches):
        fs, base = filesystem(root)
        for b in batches:
            rows = []
            for row in zip(*(b.column(c).to_pylist() for c in _FOUND.names), strict=True):
                for r in look(fs, base, *row):
                    rows.append(r)
                    if len(rows) == BATCH:
                        yield batch(rows)
                        rows = []
            yield batch(rows)

    return found.mapInArrow(run, FOUND)


def spread(spark: SparkSession) -> int:
    """Tasks that many small files are dealt over."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _located(spark: SparkSession, path: str) -> tuple[str, str, bool] | None:
    """A path as Spark writes it in full, as tasks open it, and whether it is
    a folder; None where tasks cannot open it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    root = re.sub("^file:/+", "/", whole)
    try:
        fs, base = filesystem(root)
        kind = fs.get_file_info(base).type
    except (OSError, ValueError, NotImplementedError):
        return None
    return None if kind == pafs.FileType.NotFound else (whole, root, kind == pafs.FileType.Directory)


def found_files(spark: SparkSession, path: str, enter: Callable[[str], bool]) -> tuple[DataFrame, str, str] | None:
    """``rel, size, folder`` of the files of ``path`` (a file, a folder or a
    pattern of ``*`` and ``?``), dealt over tasks; in a folder, those below
    folders whose name ``enter`` takes count too.  With it the root that
    ``rel`` goes on from, in full and as tasks open it.  None if there is
    nothing or tasks cannot open it: that is left to Spark's own sources."""
    if re.search(r"[\[\]{}\\]", path) or path.endswith(_FOREIGN):
        return None
    literal, pattern = re.match(r"([^*?]*)(?:/([^/]*[*?].*))?$", path, re.S).groups() if "/" in path else (path, None)
    at = None if re.search("[*?]", literal) else _located(spark, literal or "/")
    if at is None:
        return None
    whole, root, folder = at
    n, parts = spread(spark), [p for p in (pattern or "").split("/") if p]
    _, base = filesystem(root)
    size = 0 if folder else filesystem(root)[0].get_file_info(base).size
    found = spark.createDataFrame([("", size, folder)], FOUND).coalesce(1)
    for i, p in enumerate(parts):
        found = _looked(found.repartition(n) if i else found, root, _matching(p) if re.search("[*?]", p) else _named(p))
    if parts:
        if not found.count():
            return None
        found = found.repartition(n)
    for _ in range(max(1, LEVELS - len(parts))):
        found = _looked(found, root, _opened(enter)).repartition(n)
    return _looked(found, root, _files(enter)), whole, root


def _content(fs: pafs.FileSystem, path: str) -> bytes:
    if path.endswith(_FOREIGN):
        raise ValueError(f"{path}: a form of compression that only Spark's text source reads")
    with fs.open_input_stream(path) as f:
        data = f.read()
    return zlib.decompress(data) if path.endswith(".deflate") else data


def read_found(found: DataFrame, whole: str, root: str) -> DataFrame:
    """``path`` (as a URI) and ``content`` of files that ``found_files`` found."""
    def name(rel: str) -> str:
        return _QUOTED.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), whole + rel)

    def batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_READ)], schema=_READ)

    def run(batches):
        fs, base = filesystem(root)
        for b in batches:
            rows, held = [], 0
            for rel in b.column("rel").to_pylist():
                data = _content(fs, base + rel)
                rows.append((name(rel), data))
                held += len(data)
                if held >= BYTES or len(rows) == BATCH:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)

    return found.select("rel").repartition(spread(found.sparkSession)).mapInArrow(run, "path string, content binary")


def write_lines(lines: DataFrame, root: str, file: str) -> int:
    """Write ``(folder, value)`` rows as ``<root>/<folder>/<file>``, a line a
    row (null: an empty one); the number of files.  A task has the rows of a
    folder one after the other and one open file."""
    def write(batches):
        fs, base = filesystem(root)
        folder, out, n = None, None, 0
        try:
            for b in batches:
                for f, value in zip(b.column("folder").to_pylist(), b.column("value").to_pylist(), strict=True):
                    if f != folder:
                        if out is not None:
                            out.close()
                        fs.create_dir(f"{base}/{f}", recursive=True)
                        out = fs.open_output_stream(f"{base}/{f}/{file}", compression=None)
                        folder, n = f, n + 1
                    out.write((value or b"") + b"\n")
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = lines.select("folder", F.col("value").cast("binary").alias("value"))
    rows = rows.repartition(spread(lines.sparkSession), "folder").sortWithinPartitions("folder")
    files = rows.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0
    fs, base = filesystem(root)
    put(fs, f"{base}/_SUCCESS", b"")
    return files


# functions used in tasks travel with them (see shipping.py)
from ..shipping import ship_by_value  # noqa: E402

ship_by_value(__name__)
