"""The driver's parquet tables.

Reading goes through ``spark.read.parquet`` only, so Catalyst prunes columns
and pushes filters into the scan of whatever the caller selects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


#: schemas by path, time of change and length, so that a table's footers are read once a change
_SCHEMAS: dict[tuple[str, int, int], StructType] = {}


def _stamp(spark: SparkSession, path: str) -> tuple[str, int, int]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    return path, status.getModificationTime(), status.getLen()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The scan of one table as its files are now: they are listed anew every
    time; only the schema is remembered while the path is unchanged."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    stamp = _stamp(spark, path)
    if not stamp[1]:                                    # a store that keeps no time for it
        return spark.read.parquet(path)
    if stamp not in _SCHEMAS:
        _SCHEMAS[stamp] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[stamp]).parquet(path)


def register_tables(spark: SparkSession, sf_dir: str, names) -> None:
    """Register base tables as temp views under their own names."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
