"""Splitting the members of index buckets into units of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def on_keys(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``facts``, an aggregate of one row per
    ``keys``; null keys meet like any other.  The keys are wrapped in a
    struct, so the small side is shuffled anew instead of being read from its
    aggregation's own shuffle, and AQE can split a hot key of ``rows``."""
    facts = facts.select(F.struct(*keys).alias("_on"), *[c for c in facts.columns if c not in keys])
    return rows.join(facts, F.struct(*[rows[k] for k in keys]) == F.col("_on"), how).drop("_on")


def bucket_units(postings: DataFrame, key: list[str], member: str, block: int) -> DataFrame:
    """Rows of every bucket of two or more members, with a unit ``_i, _j`` and
    the member's block ``_c``: a bucket of up to ``block`` rows is the unit
    (0, 0); a larger one is cut into blocks by the member's hash, and each
    pair of blocks is a unit, so that any two members meet in exactly one
    unit that compares them (their blocks' pair) and no unit holds much more
    than two blocks."""
    sizes = postings.groupBy(*key).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > 1)
    d = on_keys(postings, sizes, key)
    d = d.withColumn("_blocks", F.ceil(F.col("_size") / block).cast("int"))
    d = d.withColumn("_c", F.pmod(F.xxhash64(member, F.lit(block)), F.col("_blocks")).cast("int"))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return d.withColumn("_i", F.least("_c", "_o")).withColumn("_j", F.greatest("_c", "_o")).drop("_size", "_blocks", "_o")
