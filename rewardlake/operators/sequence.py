"""Order-dependent operators and the chunked
scan they share.

Rules used throughout:

* Only order-dependent work uses an ordered window.  Where one key may be
  huge, either the window is partitioned by (key, order-range chunk) and what
  a row needs from earlier chunks comes from a small per-chunk table
  (``chunked_scan``, for order values that spread, such as positions), or the
  rows go through an associative scan over range partitions
  (``machines.scan``: an episode's steps, a user's events), which also spreads
  a key that is hot inside one day.
* Whatever is order-*independent* (first terminal position, totals, means)
  is a ``groupBy`` (map-side partial aggregation) joined back, because AQE
  splits a skewed join partition but cannot split a window partition.
* Global "first n" is ``orderBy().limit()``, which plans as a distributed
  top-k (TakeOrderedAndProject), not a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_back
from .machines import Machine, scan


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """B1: first ``n`` rows in dataset order; ``n == 0`` means all."""
    return df if n <= 0 else df.orderBy(order).limit(n)


def chunked_scan(df: DataFrame, keys: list[str], order: list[str], chunk: Column | str,
                 sums: dict[str, Column] | None = None, lags: dict[str, str] | None = None,
                 firsts: dict[str, str] | None = None, keep_chunk: str | None = None) -> DataFrame:
    """Running sums and previous-row values per ``keys`` in ``order``,
    without putting a whole key into one task.

    ``chunk`` must be non-decreasing in ``order`` within a key (an order
    range: a day of ``ts``, a block of positions).  The ordered window runs
    per (key, chunk), so a key holding a third of the rows is spread over
    its chunks.  What a row needs from earlier chunks -- the sums of all
    earlier chunks, the last value of the previous chunk -- comes from a
    one-row-per-chunk table, joined back on the partitioning the window
    already produced, so only that small side moves.

    ``sums``: output name -> value (inclusive running sum).  ``lags``:
    output name -> column (its value on the previous row; null on the
    first row of the key).  ``firsts``: output name -> column (its value on
    the key's first row).  ``keep_chunk`` keeps the chunk under that name,
    and ``chunk`` may name such a column in a second scan.  Null keys and null
    chunks are groups of their own, as in SQL windows.
    """
    sums, lags, firsts = dict(sums or {}), dict(lags or {}), dict(firsts or {})
    d = df.withColumn("_chunk", F.col(chunk) if isinstance(chunk, str) else chunk)
    # a struct is never null itself, so rows with a null key or chunk are a
    # group like any other, in the window and in the join
    d = d.withColumn("_group", F.struct(*keys, "_chunk"))
    for i, (name, value) in enumerate(sums.items()):
        d = d.withColumn(f"_v{i}", value)
    w = Window.partitionBy("_group").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = d.select("*", *[F.sum(f"_v{i}").over(upto).alias(f"_s{i}") for i in range(len(sums))],
                     *[F.lag(c).over(w).alias(f"_l{j}") for j, c in enumerate(lags.values())],
                     (F.row_number().over(w) == 1).alias("_first"))
    ordering = F.struct(*[F.col(c) for c in order])
    per_chunk = d.groupBy("_group").agg(
        *[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))],
        *[F.max_by(F.col(c), ordering).alias(f"_e{j}") for j, c in enumerate(lags.values())],
        *[F.min_by(F.col(c), ordering).alias(f"_b{j}") for j, c in enumerate(firsts.values())])
    per_chunk = per_chunk.withColumn("_chunk", F.col("_group._chunk"))
    inside = [F.col(f"_group.{k}") for k in keys]
    cw = Window.partitionBy(*inside).orderBy("_chunk") if keys else Window.orderBy("_chunk")
    before = cw.rowsBetween(Window.unboundedPreceding, -1)
    whole = cw.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_chunk.select(
        "_group",
        *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(sums))],
        *[F.lag(f"_e{j}").over(cw).alias(f"_p{j}") for j in range(len(lags))],
        *[F.first(f"_b{j}").over(whole).alias(f"_g{j}") for j in range(len(firsts))])
    out = local.join(offsets, "_group")
    for i, name in enumerate(sums):
        out = out.withColumn(name, F.col(f"_s{i}") + F.col(f"_o{i}"))
    for j, name in enumerate(lags):
        out = out.withColumn(name, F.when(F.col("_first"), F.col(f"_p{j}")).otherwise(F.col(f"_l{j}")))
    for j, name in enumerate(firsts):
        out = out.withColumnRenamed(f"_g{j}", name)
    if keep_chunk:
        out = out.withColumnRenamed("_chunk", keep_chunk)
    helper = ["_group", "_chunk", "_first"] + [f"_{x}{i}" for i in range(len(sums)) for x in "vso"] + \
        [f"_{x}{j}" for j in range(len(lags)) for x in "lp"]
    return out.drop(*helper)


def running_sum(df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: Column,
                out: str) -> DataFrame:
    """Inclusive running sum of ``value`` per ``keys`` (see ``chunked_scan``)."""
    return chunked_scan(df, keys, order, chunk, sums={out: value})


def round_robin(df: DataFrame, key: str | None, order: str, workers: int,
                chunk_width: int = 1 << 16) -> DataFrame:
    """Row *i* (0-based, in ``order``) goes to worker ``i % workers``
    within each ``key`` (or over the whole table when ``key`` is None).

    The row index is a chunked running count (``running_sum``), so neither a
    hot key nor the unkeyed case runs in a single task.  For spreading
    *work* rather than recording the assignment, ``df.repartition(n)`` is
    round-robin already.
    """
    keys = [key] if key else []
    chunk = F.floor(F.col(order) / F.lit(chunk_width))
    ranked = running_sum(df, keys, [order], chunk, F.lit(1), "_rn")
    return ranked.withColumn("worker", ((F.col("_rn") - 1) % workers).cast("bigint")).drop("_rn")


def prefix_until(df: DataFrame, key: str, order: list[str], stop: Column) -> DataFrame:
    """Keep each key's rows strictly before its first ``stop`` row.

    The first stop position is an aggregate (``min`` of the ordering
    struct), so it is computed with partial aggregation and joined back
    instead of a running window.
    """
    ordering = F.struct(*[F.col(c) for c in order])
    first_stop = (df.filter(stop).groupBy(key)
                  .agg(F.min(ordering).alias("_first_stop")))
    return (join_back(df, first_stop, key, "left")
            .filter(F.col("_first_stop").isNull() | (ordering < F.col("_first_stop")))
            .drop("_first_stop"))


#: a success opens a new island: failures with one count of successes before them are consecutive
ISLANDS = Machine(("run",), ("fail", "ok"), counts={"island": {("run", "ok"): 1}})


def streaks(df: DataFrame, key: str, order: list[str], is_fail: Column) -> DataFrame:
    """E10 gaps-and-islands: length of every run of consecutive failures.

    Island id = running count of successes up to the row, by an associative
    scan (``machines.scan``), so a key that is hot inside one day or even one
    second is spread; the failures that share an island are consecutive.
    Returns ``(key, island, run_length)`` for islands with failures.
    """
    fail = F.coalesce(is_fail, F.lit(False))
    tagged = df.select(key, *order, F.when(fail, F.lit("fail")).otherwise(F.lit("ok")).alias("_i"))
    islands = scan(tagged, [key], order, ISLANDS, F.col("_i"))
    return (islands.filter(F.col("_i") == "fail").groupBy(key, "island")
            .agg(F.count(F.lit(1)).alias("run_length")))


def breaker(df: DataFrame, key: str, order: list[str], is_fail: Column, limit: int = 10) -> DataFrame:
    """Per key, the longest run of consecutive failures and whether the
    breaker trips (``limit`` in a row; a success resets the counter)."""
    keys = df.select(key).distinct()
    runs = (streaks(df, key, order, is_fail).groupBy(key)
            .agg(F.max("run_length").alias("max_streak")))
    return (keys.join(runs, key, "left")
            .select(key, F.coalesce(F.col("max_streak"), F.lit(0)).cast("bigint").alias("max_streak"),
                    (F.coalesce(F.col("max_streak"), F.lit(0)) >= limit).alias("tripped")))


def first_success(df: DataFrame, key: str, order: str, value: str, ok: Column,
                  none: str = "failed") -> DataFrame:
    """The first ``value`` in ``order`` whose attempt succeeded, else
    ``none`` (``min_by`` with a filter; partial aggregation)."""
    return (df.groupBy(key)
            .agg(F.min_by(F.when(ok, F.col(value)), F.when(ok, F.col(order))).alias("_first"))
            .select(key, F.coalesce(F.col("_first"), F.lit(none)).alias(value)))


def run_until_stop(df: DataFrame, key: str, order: list[str], stop: Column, fail: Column) -> DataFrame:
    """E9 per key: rows are processed in ``order`` until the first ``stop``
    row (which ends the run unprocessed); other failures before it are
    counted and skipped.  Returns processed, failed, stopped and remaining
    per key -- one aggregation after joining the first stop position."""
    ordering = F.struct(*[F.col(c) for c in order])
    first_stop = df.filter(stop).groupBy(key).agg(F.min(ordering).alias("_stop"))
    j = join_back(df, first_stop, key, "left")
    before = F.col("_stop").isNull() | (ordering < F.col("_stop"))
    g = j.groupBy(key).agg(
        F.count(F.lit(1)).alias("_total"),
        F.count_if(before & ~fail).alias("processed"),
        F.count_if(before & fail).alias("failed"),
        F.bool_or(F.col("_stop").isNotNull()).alias("stopped"))
    return g.select(key, F.col("processed").cast("bigint").alias("processed"),
                    F.col("failed").cast("bigint").alias("failed"), "stopped",
                    (F.col("_total") - F.col("processed") - F.col("failed")).cast("bigint").alias("remaining"))
