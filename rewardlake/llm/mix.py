"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the copy number every document of it
should get.  The whole part is taken; the fractions are settled in pairs:
words are moved at random from one document's fraction to the other's until
one of them is 0 or 1, which keeps both the expected copies of each document
and the source's word total.  Each bucket of documents does so in one
streaming pass that holds a single open document and leaves at most one
fraction per source; the left-over fractions meet in a reduction tree, and
only the last one of a source is rounded alone, so a source misses its
target by less than one document.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_by_value
from .common import cut_lineage, words_of

ship_by_value(__name__)

#: weights of the sources in code-point order, repeating; share of all words; most copies
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: documents of a bucket, buckets that meet in a node of the tree, seed of the draws
BUCKET, FAN_IN, SEED = 50_000, 16, 11
#: copies of one row that are expanded at once
COPIES = 65_536
EPS = 1e-9


def source_targets(items: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target``: ``share`` of all words divided by
    weight, no source above ``most`` times its size, the excess reshared by
    weight.  With sources ordered by cap over weight the common level is the
    largest of (what remains after the first j caps) / (the other weights).
    The windows run over one row per source."""
    s = items.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("bigint").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("_w", F.get(kinds, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))) \
         .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source"))
    before, all_ = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(all_) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_w = F.sum("_w").over(all_) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    s = s.withColumn("_level", rest / open_w)
    return s.select("source", "source_size",
                    F.least("_cap", F.max("_level").over(all_) * F.col("_w")).alias("target"))


def pivot(p1: float, s1: int, p2: float, s2: int, u: float) -> tuple[float, float]:
    """Move words between two fractions until one is integral."""
    up, down = min(s1 * (1 - p1), s2 * p2), min(s1 * p1, s2 * (1 - p2))
    d = up if u * (up + down) < down else -down
    return p1 + d / s1, p2 - d / s2


def _settle(batches):
    """Rows sorted by (node, source): each with ``up`` 0 or 1, or with its
    fraction ``p`` left if it is its node's last open one."""
    held, at = None, None

    def settled(row, p):
        return {**row, "p": 0.0, "up": 1 if p > 0.5 else 0}

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            here = (row["node"], row["source"])
            if here != at:
                if held:
                    out.append({**held, "up": None})
                held, at = None, here
            if not EPS < row["p"] < 1 - EPS or row["size"] == 0:
                out.append(settled(row, row["p"] if row["size"] else 0.0))
            elif held is None:
                held = row
            else:
                p1, p2 = pivot(held["p"], held["size"], row["p"], row["size"], row["u"])
                done1, done2 = (not EPS < p < 1 - EPS for p in (p1, p2))
                if done1:
                    out.append(settled(held, p1))
                if done2:
                    out.append(settled(row, p2))
                held = None if done1 and done2 else {**(row if done1 else held), "p": p2 if done1 else p1}
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_schema(batch.schema))
    if held:
        yield pa.RecordBatch.from_pylist([{**held, "up": None}], schema=_schema(batch.schema))


def _schema(s: pa.Schema) -> pa.Schema:
    return s if "up" in s.names else s.append(pa.field("up", pa.int32()))


def _level(items: DataFrame, nodes: int) -> DataFrame:
    d = items.repartition(max(1, nodes), "node").sortWithinPartitions("node", "source", F.desc("size"), "u", "item")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema if f.name != "up")
    return cut_lineage(d.drop("up").mapInArrow(_settle, f"{kinds}, up int"))


def _uniform(*key: Column) -> Column:
    return (F.xxhash64(*key, F.lit(SEED)).cast("double") + float(1 << 63)) / float(1 << 64)


def mix_items(items: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST,
              bucket: int = BUCKET) -> DataFrame:
    """``items`` has one row per distinct (doc_id, source, size) with ``n``
    rows behind it.  Adds ``source_size, target, whole`` (copies every row
    gets) and ``extra`` (how many of the n rows get one more).

    The draws depend on ids, sources and sizes alone, so reruns agree."""
    d = items.join(source_targets(items, weights, share, most).withColumnRenamed("source", "_s"),
                   F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    c = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    d = d.withColumn("_c", c).withColumn("whole", F.floor("_c").cast("bigint"))
    d = d.withColumn("_t", (F.col("_c") - F.col("whole")) * F.col("n")).withColumn("_k", F.floor(F.col("_t") + EPS).cast("bigint"))
    d = d.withColumn("p", F.greatest(F.lit(0.0), F.col("_t") - F.col("_k")))
    d = d.withColumn("item", F.xxhash64("doc_id", "source", "size")).withColumn("u", _uniform("doc_id", "source", "size"))
    d = cut_lineage(d.drop("_c", "_t"))
    nodes = max(1, -(-d.count() // bucket))
    left = d.withColumn("node", F.pmod("item", F.lit(nodes)).cast("int"))
    done = []
    while True:
        out = _level(left, nodes)
        done.append(out.where(F.col("up").isNotNull()))
        rest = out.where(F.col("up").isNull())
        if nodes == 1:
            done.append(rest.withColumn("up", (F.col("p") >= 0.5).cast("int")))
            break
        nodes = -(-nodes // FAN_IN)
        left = rest.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("int"))
    all_ = done[0]
    for x in done[1:]:
        all_ = all_.unionByName(x)
    return all_.withColumn("extra", F.col("_k") + F.col("up")).drop("_k", "up", "p", "u", "item", "node")


def document_items(docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, source, size) with its row count ``n``:
    a record that makes up a third of the table is one row from here on."""
    size = F.size(words_of(F.coalesce(F.col("text"), F.lit("")))).cast("bigint")
    return cut_lineage(docs.select("doc_id", "source", size.alias("size"))
                       .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))


def mix_plan(docs: DataFrame, **settings) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target,
    copies`` (how often the mix takes the row).

    Defined cases: null text has size 0 and is never taken; a null source is
    one source, last in order; rows equal in id, source and size share their
    copies evenly; an empty table gives an empty result."""
    d = mix_items(document_items(docs), **settings)
    d = d.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {COPIES}"))))
    d = d.withColumn("_i", F.explode(F.sequence(F.col("_b") * COPIES, F.least(F.col("n"), (F.col("_b") + 1) * COPIES) - 1)))
    return d.select("doc_id", "source", "size", "source_size", "target",
                    (F.col("whole") + (F.col("_i") < F.col("extra")).cast("bigint")).alias("copies"))


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.
    Rows that share id, source and size take their extra copies in text
    order; wholly equal ones are counted first, so a row repeated over a
    third of the table is one row in the shuffle."""
    plan = mix_items(document_items(docs), **settings).select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "whole", "extra")
    d = docs.select(F.struct(*docs.columns).alias("row"))
    d = d.withColumn("_size", F.size(words_of(F.coalesce(F.col("row.text"), F.lit("")))).cast("bigint"))
    on = F.col("row.doc_id").eqNullSafe(F.col("_d")) & F.col("row.source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z"))
    d = d.join(plan, on)
    single = d.where(F.col("n") == 1).select("row", (F.col("whole") + F.col("extra")).alias("_copies"))
    held = d.where(F.col("n") > 1).groupBy("row", "_d", "_s", "_z", "whole", "extra").agg(F.count(F.lit(1)).alias("_m"))
    same = Window.partitionBy("_d", "_s", "_z").orderBy("row.text", F.to_json("row"))
    before = F.coalesce(F.sum("_m").over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("_m"), F.col("extra") - before))
    many = held.select("row", (F.col("whole") * F.col("_m") + more).alias("_copies"))
    d = single.unionByName(many).where(F.col("_copies") > 0)
    d = d.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_copies - 1) div {COPIES}"))))
    d = d.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(COPIES).cast("bigint"), F.col("_copies") - F.col("_b") * COPIES))))
    return d.select("row.*")
