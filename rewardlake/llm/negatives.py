"""Hard negatives by slot decomposition.

An anchor's positives give upper limits for its negatives' scores.  The
limits cut the scores into disjoint slots (below each limit, down to the
next), so a window that ends at a limit is a run of slots from there on
downward.  Units of rows keep the best ``k`` of every slot, partial results
of an anchor's slot are merged into ``k`` again, and one descending merge of
the at most ``positives * k`` rows left answers all overlapping windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_by_value
from .common import cut_lineage
from .units import GROUP, LANE, PIECE, best_k, dealt, in_units, inner, matrix, scaled, whole_vector

ship_by_value(__name__)

_FOUND = pa.schema([("qid", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])
_FOUND_SQL = "qid bigint, slot int, score bigint, id bigint"


def _pieces(rows: int, columns: int):
    step = max(1, PIECE // max(1, columns))
    return [slice(s, min(rows, s + step)) for s in range(0, rows, step)]


def _table(parts: list) -> pa.Table:
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[]] * 4
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND, strict=True)], schema=_FOUND)


def _unit(rows: pa.Table, queries: pa.Table):
    """ids, labels and vectors of a unit's rows by ascending id, and of its anchors."""
    ids = rows.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return (ids[order], rows.column("label").to_numpy()[order], matrix(rows, "x")[order],
            queries.column("qid").to_numpy(), queries.column("id").to_numpy(),
            queries.column("label").to_numpy(), matrix(queries, "x"))


def _positives(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, labels, x, qid, qids, qlabels, q = _unit(rows, queries)
        parts = []
        for label in np.intersect1d(qlabels, labels):
            mine, theirs = np.nonzero(qlabels == label)[0], np.nonzero(labels == label)[0]
            for at in _pieces(len(mine), len(theirs)):
                a = mine[at]
                s = inner(q[a], x[theirs])
                r, c = best_k(s, qids[a][:, None] != ids[theirs][None, :], k)
                parts.append((qid[a][r], np.zeros(len(r), np.int32), s[r, c], ids[theirs][c]))
        return _table(parts)
    return run


def _slots(k: int, low: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, labels, x, qid, _, qlabels, q = _unit(rows, queries)
        limits = queries.column("limits").to_pylist()
        parts = []
        for at in _pieces(len(q), len(x)):
            s, other = inner(q[at], x), qlabels[at][:, None] != labels[None, :]
            mine = limits[at]
            for slot in range(max((len(m) for m in mine), default=0)):
                has = np.array([i for i, m in enumerate(mine) if len(m) > slot])
                t = s[has]
                top = np.array([mine[i][slot] for i in has], np.int64)[:, None]
                floor = np.array([-(-mine[i][slot] * low // 100) for i in has], np.int64)[:, None]
                here = other[has] & (t <= top) & (t >= floor)
                below = [i for i, j in enumerate(has) if len(mine[j]) > slot + 1]
                if below:
                    nxt = np.array([mine[has[i]][slot + 1] for i in below], np.int64)[:, None]
                    here[below] &= t[below] > nxt
                r, c = best_k(t, here, k)
                parts.append((qid[at][has[r]], np.full(len(r), slot, np.int32), t[r, c], ids[c]))
        return _table(parts)
    return run


def _merge(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best of every key; partial ones are cut before the shuffle."""
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80,
                   scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None,
                   lane: int = LANE, group: int = GROUP) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: for every anchor (rows where ``is_anchor``) and each of
    its ``positives`` best other rows of its ``label`` the ``negatives`` best
    rows of another label whose score is at most the positive's and at least
    ``low`` per cent of it.  Scores are exact inner products of the
    components times ``scale``, rounded down; ties go to the smaller id.

    Defined cases: rows with a null id or label, or a vector that is null or
    holds a null or non-finite component, take no part; vectors of different
    lengths never meet (empty ones score 0 with each other); an anchor is
    never its own positive, nor is any other row of its id; wholly equal
    anchors are answered once, unlike ones of one id each on its own;
    repeated rows that are no anchors are candidates each; labels may be
    integers of any size; a negative positive score has an empty window; an
    anchor without positives or negatives returns nothing; an empty table
    gives an empty result; other columns are not read.  A component that
    takes 62 bits or a score of 56 bits or more may be an error, never a wrong row.
    """
    label = F.col("label") if label is None else label
    # the anchor test runs on the table's own columns
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
                          F.col(vec_col).alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")) \
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & whole_vector(F.col("vec")))
    rows = rows.select("id", "label", scaled(F.col("vec"), scale).alias("x"), "anchor").withColumn("dim", F.size("x"))
    rows, lanes = dealt(rows, lane, "lane")
    anchors = rows.where("anchor").select("id", "label", "dim", "x").distinct()
    anchors, groups = dealt(anchors, group, "grp")
    anchors = cut_lineage(anchors.withColumn("qid", F.monotonically_increasing_id()))
    rows = rows.select("id", "label", "dim", "x", "lane")

    near = in_units(rows, lanes, anchors, groups, _positives(positives), _FOUND_SQL)
    near = cut_lineage(_merge(near, ["qid"], positives).select("qid", "nth", "score", "id"))
    limits = near.groupBy("qid").agg(F.sort_array(F.collect_set("score"), asc=False).alias("limits"))
    found = in_units(rows, lanes, anchors.join(limits, "qid"), groups, _slots(negatives, low), _FOUND_SQL)
    slots = _merge(found, ["qid", "slot"], negatives)
    # at most positives * negatives rows an anchor, by falling score: every window is a part of this list
    falling = slots.groupBy("qid").agg(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("minus"), F.col("id").alias("id")))).alias("falling"))
    p = F.col("score")
    window = F.filter("falling", lambda e: (-e["minus"] <= p) & (F.lit(100) * -e["minus"] >= F.lit(low) * p))
    return near.join(falling, "qid").join(anchors.select("qid", F.col("id").alias("anchor_id")), "qid") \
        .select("anchor_id", F.col("id").alias("positive_id"), p.alias("positive_score"),
                F.posexplode(F.slice(window, 1, negatives)).alias("pos", "e")) \
        .select("anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.id").alias("negative_id"),
                "positive_score", (-F.col("e.minus")).alias("negative_score"))
