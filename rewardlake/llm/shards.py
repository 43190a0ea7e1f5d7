"""Sharding by weighted rendezvous (highest-random-weight) hashing.

Every (key, shard) pair gets a fixed pseudo-random number u in (0, 1); the
record goes to the shard with the smallest ``-ln(u) / weight``.  The choice
depends on the key and the shard list alone, so a new shard only takes
records (its own wins) and never moves one between two old shards, and each
shard receives keys in proportion to its weight.

Everything is Column expressions plus one running count; no Python runs on
the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quantile_bounds, range_chunk, shuffle_parts

#: hex digits of the digest that make u, and the width they span
DIGITS, SPAN = 13, float(1 << 52)
#: copies of one record that are expanded at once
BLOCK = 65_536


def _race(key: Column, shard: int, weight: float) -> Column:
    digest = F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / SPAN
    return F.struct((-F.ln(u) / F.lit(float(weight))).alias("t"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard (0-based position in ``weights``) of a key given as text.  A
    weight of 0 never wins.  Ties (equal digests) go to the lower shard."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be non-negative, one at least positive")
    entries = [_race(key, i, w) for i, w in enumerate(weights) if w > 0]
    best = entries[0] if len(entries) == 1 else F.least(*entries)
    return best["shard"]


def record_key(doc_id: Column, text: Column) -> Column:
    """Stable key of a record: its id as text; a record without an id is
    keyed by its text's digest, so null ids spread over the shards."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8,
                    grown: Sequence[float] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, shard, slot,
    grown_shard``.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1.  ``slot``
    numbers a shard's rows from 0 without gaps in the order (doc_id, size,
    crc), null ids first.  ``grown_shard`` is the shard under ``grown``
    (default: one more shard of the first weight).

    The law is ``key``: the id and the number of shards decide.  One
    exception: a row without an id has no key, so its text stands in for it
    (else all such rows would be one hot shard); it too moves into a new
    shard only.  Defined cases: null text counts as empty; repeated rows are counted
    first (one row per distinct record, so a record that makes up a third
    of the table is one row in the shuffle) and numbered one after another;
    an empty table gives an empty result; other columns are not read.
    """
    grown = tuple(grown) if grown is not None else (*weights, weights[0])
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), record_key(F.col("doc_id"), F.col("text")).alias("_key"))
    held = rows.groupBy("doc_id", "size", "text_crc32", "_key").agg(F.count(F.lit(1)).alias("_n"))
    held = held.withColumn("shard", rendezvous(F.col("_key"), weights)) \
               .withColumn("grown_shard", rendezvous(F.col("_key"), grown)).drop("_key")
    numbered = _first_slots(held, quantile_bounds(docs, "doc_id", 2 * shuffle_parts(docs.sparkSession)))
    blocks = numbered.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {BLOCK}"))))
    copies = blocks.withColumn("_i", F.explode(F.sequence(
        F.col("_b") * BLOCK, F.least(F.col("_n"), (F.col("_b") + 1) * BLOCK) - 1)))
    return copies.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
                         (F.col("_first") + F.col("_i")).cast("bigint").alias("slot"),
                         F.col("grown_shard").cast("int").alias("grown_shard"))


def _first_slots(held: DataFrame, bounds: list[float]) -> DataFrame:
    """Running count per shard in id order.  The ordered window runs per
    (shard, id range); the counts of earlier ranges come from a table of one
    row per (shard, range)."""
    d = held.withColumn("_chunk", range_chunk(F.col("doc_id"), bounds))
    order = ["doc_id", "size", "text_crc32"]
    w = Window.partitionBy("shard", "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumn("_upto", F.sum("_n").over(w))
    per = d.groupBy("shard", "_chunk").agg(F.sum("_n").alias("_t"))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = per.select("shard", "_chunk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    return local.join(offset, ["shard", "_chunk"]).withColumn("_first", F.col("_off") + F.col("_upto") - F.col("_n"))
