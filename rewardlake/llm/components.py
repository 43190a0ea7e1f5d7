"""Connected components of an edge table by alternating star contractions.

A large star links every larger neighbour of a node to the smallest node of
its neighbourhood, a small star does so with the smaller neighbours; a few
alternations turn every component into one star around its smallest node.
Only aggregates and equi-joins on the edge table (on wrapped keys, so that
the star around a large component's smallest node can be split), cut by a
reliable checkpoint each round; nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import on_keys
from .common import cut_lineage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return on_keys(both, low, ["u"]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = on_keys(e, low, ["u"]).where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: every node of an edge but the smallest of its
    component, with that smallest node.  Nulls and loops are ignored; nodes
    that are absent are their own component."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")) \
             .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = cut_lineage(e)
    mark = _mark(e)
    while mark[0]:
        e = cut_lineage(_small_star(_large_star(e)))
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
