"""A stated set of query vectors against all rows, in units of bounded size.

Rows are dealt evenly over lanes, queries over groups (by a number, not by a
key, so no id, label or copy can make one large), and a unit is one lane with
one group: every query meets every row of its vector length in exactly one
unit, and no task holds more than a lane and a group of a length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_by_value
from .common import cut_lineage

ship_by_value(__name__)

#: rows of a lane and queries of a group, and rows below which a lane is not cut for more parallel tasks
LANE, GROUP, LEAST = 32768, 16384, 1024
#: scores held at once
PIECE = 1 << 22


def whole_vector(vec: Column) -> Column:
    """Not null, and every component is a finite number."""
    v = vec.cast("array<double>")
    return F.coalesce(F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))), F.lit(False))


def scaled(vec: Column, scale: int) -> Column:
    """floor(scale * component) of every component, as double, then long.
    Fails where a result has 63 bits or more."""
    def one(c: Column) -> Column:
        y = F.floor(c * F.lit(float(scale)))
        return F.when(F.abs(c * F.lit(float(scale))) < 2.0 ** 62, y).otherwise(
            F.raise_error(F.lit("a scaled component does not fit 62 bits")).cast("bigint"))
    return F.transform(vec.cast("array<double>"), one)


def dealt(rows: DataFrame, lane: int, name: str) -> tuple[DataFrame, int]:
    """``rows`` with a lane number ``name``, fixed by a checkpoint, and the
    number of lanes."""
    n = rows.count()
    wide = rows.sparkSession.sparkContext.defaultParallelism
    lanes = max(1, -(-n // lane), min(wide, n // LEAST))
    return cut_lineage(rows.withColumn(name, F.pmod(F.monotonically_increasing_id(), F.lit(lanes)).cast("int"))), lanes


def in_units(rows: DataFrame, lanes: int, queries: DataFrame, groups: int,
             run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run(rows, queries)`` for every unit.  ``rows`` have ``dim`` and
    ``lane``, ``queries`` ``dim`` and ``grp``."""
    left = rows.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # both sides may come from one table: new columns keep the sides apart
    right = queries.select(*[F.col(c).alias(c) for c in queries.columns]).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    key = ["dim", "lane", "grp"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


def matrix(table: pa.Table, col: str) -> np.ndarray:
    """The equally long integer lists of a column as the rows of a matrix."""
    flat = table.column(col).combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, -1 if len(flat) else 0)


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; an error where one could
    exceed a long."""
    if not (q.size and x.size):
        return np.zeros((len(q), len(x)), np.int64)
    bound = int(np.abs(q).max()) * int(np.abs(x).max()) * q.shape[1]
    if bound < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return q @ x.T
    exact = q.astype(object) @ x.astype(object).T
    if max(abs(int(v)) for v in exact.flat) >= 1 << 63:
        raise OverflowError("an inner product does not fit a long")
    return exact.astype(np.int64)


def best_k(scores: np.ndarray, usable: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``k`` highest usable scores of every
    row, ties by column."""
    n = scores.shape[1]
    if n > k:
        low = np.iinfo(np.int64).min
        masked = np.where(usable, scores, low)
        kth = np.partition(masked, n - k, axis=1)[:, n - k]
        usable = usable & (masked >= kth[:, None])
    row, col = np.nonzero(usable)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], col[nth < k]
