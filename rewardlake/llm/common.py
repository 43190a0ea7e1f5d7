"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return
SPACE = "\\x20\\x09-\\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: what follows starts from files every executor can read."""
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/rewardlake-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (never a local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has (case ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """The runs of non-white-space of a text (ASCII white space)."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def quantile_bounds(df: DataFrame, col: str, n: int) -> list[float]:
    """At most ``n - 1`` ascending cut points that split ``col`` into ranges
    of about equal row counts (a quantile sketch; ``n`` numbers reach the
    driver)."""
    if n < 2:
        return []
    probs = [i / n for i in range(1, n)]
    return sorted(set(df.approxQuantile(col, probs, 1 / (4 * n)) or []))


def range_chunk(x: Column, bounds: Sequence[float]) -> Column:
    """Number of ``bounds`` at or below ``x``: a binary search over a literal
    array.  Never decreases as ``x`` grows; null goes to chunk -1."""
    m = len(bounds)
    if not m:
        return F.when(x.isNull(), F.lit(-1)).otherwise(F.lit(0))
    arr, v = F.array(*[F.lit(float(b)) for b in bounds]), x.cast("double")
    steps = [1 << i for i in range(m.bit_length() - 1, -1, -1)]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda pos, s: F.when((pos + s <= m) & (F.get(arr, pos + s - 1) <= v), pos + s).otherwise(pos))
    return F.when(x.isNull(), F.lit(-1)).otherwise(found)
