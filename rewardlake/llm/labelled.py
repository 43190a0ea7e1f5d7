"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may learn from: crc32 of the id as text
    leaves 2 on division by 4 (a null id: as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def training_sample(docs: DataFrame, labels: DataFrame, column: str, limit: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``limit`` labelled documents that are
    not held out, chosen by the hash of their ids.

    The broadcast side has at most ``limit`` rows.  An id labelled twice gets
    its larger label; null labels are no labels; of documents that share an
    id one is taken.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col(column).isNotNull() & F.col("doc_id").isNotNull()) \
                  .groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    return cut_lineage(rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")))
