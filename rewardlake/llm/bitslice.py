"""Exact top-k by inner product on a bit-sliced index.

Every lane of rows is indexed by bitmaps: slice ``b`` of a dimension holds
bit ``b`` of all rows' quantised attribute (its distance from the lane's
least value, the leading ``SLICES`` bits).  A query adds the slices, shifted
by the bits of its weights, with carry-save adders on whole bitmaps, which
gives the quantised score of all rows as slices again; a negative weight adds
the complement.  Going down from the most significant slice finds the
``k``-th highest quantised score, a second pass the rows whose quantisation
error may lift them among the ``k``, and those are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_by_value
from .common import cut_lineage
from .units import GROUP, LANE, dealt, in_units, inner, matrix, scaled, whole_vector

ship_by_value(__name__)

#: leading bits of an attribute that the index holds
SLICES = 6

_FOUND = pa.schema([("qid", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])


def bitmap(bits: np.ndarray) -> np.ndarray:
    """The booleans of the last axis as 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (bits.ndim - 1) + [(0, pad)])).view(np.uint64)


def members(words: np.ndarray, n: int) -> np.ndarray:
    """Row numbers of a bitmap's set bits."""
    return np.nonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])[0]


def count(words: np.ndarray) -> int:
    return int(np.bitwise_count(words).sum())


class SlicedIndex:
    """Bit slices of the integer rows ``x``."""

    def __init__(self, x: np.ndarray, slices: int = SLICES):
        self.x = x
        n, dims = x.shape
        rise = x - x.min(axis=0) if n else x
        width = int(rise.max(initial=0)).bit_length()
        self.drop = max(0, width - slices)
        self.depth = min(width, slices)
        high = (rise >> self.drop).T
        kept = np.stack([bitmap((high >> b) & 1 == 1) for b in range(self.depth)], axis=1) if self.depth and dims \
            else np.zeros((dims, 0, -(-n // 64)), np.uint64)
        # a dimension's slices, and after all dimensions their complements
        self.slices = np.concatenate([kept, ~kept])
        self.rows = bitmap(np.ones(n, bool))

    def add(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum of all attributes
        times their weights (times the complement for a negative weight)."""
        dims = len(weights)
        pick = np.where(weights < 0, np.arange(dims) + dims, np.arange(dims))
        size = np.abs(weights)
        columns: list[list[np.ndarray]] = []
        for j in range(int(size.max(initial=0)).bit_length()):
            at = pick[(size >> j) & 1 == 1]
            for b in range(self.depth):
                while len(columns) <= j + b:
                    columns.append([])
                if len(at):
                    columns[j + b].append(self.slices[at, b])
        out, c = [], 0
        while c < len(columns):
            x = np.concatenate(columns[c]) if columns[c] else np.zeros((1, len(self.rows)), np.uint64)
            carried = []
            while len(x) > 2:
                t = len(x) // 3
                a, b, d = x[:t], x[t:2 * t], x[2 * t:3 * t]
                half = a ^ b
                carried.append((a & b) | (half & d))
                x = np.concatenate([half ^ d, x[3 * t:]])
            if len(x) == 2:
                carried.append(x[:1] & x[1:])
                x = x[:1] ^ x[1:]
            if carried:
                if c + 1 == len(columns):
                    columns.append([])
                columns[c + 1] += carried
            out.append(x[0])
            columns[c] = []
            c += 1
        return out

    @staticmethod
    def kth(total: list[np.ndarray], among: np.ndarray, k: int) -> int:
        """The ``k``-th highest sum among the rows of a bitmap that has at
        least ``k``, from the most significant slice downward."""
        above, level, value = 0, among, 0
        for i in range(len(total) - 1, -1, -1):
            ones = level & total[i]
            n = count(ones)
            if above + n >= k:
                level, value = ones, value | 1 << i
            else:
                above, level = above + n, level & ~total[i]
        return value

    @staticmethod
    def at_least(total: list[np.ndarray], among: np.ndarray, value: int) -> np.ndarray:
        """Bitmap of the rows whose sum is ``value`` or more."""
        if value <= 0:
            return among
        if value >> len(total):
            return np.zeros_like(among)
        above, equal = np.zeros_like(among), among
        for i in range(len(total) - 1, -1, -1):
            if value >> i & 1:
                equal = equal & total[i]
            else:
                above |= equal & total[i]
                equal = equal & ~total[i]
        return above | equal

    def candidates(self, q: np.ndarray, k: int, among: np.ndarray) -> np.ndarray:
        """Numbers of the rows that may be among the ``k`` best of those in
        a bitmap; all that belong there are in it."""
        if count(among) <= k:
            return members(among, len(self.x))
        total = self.add(q)
        # dropped bits move a score by less than this many units of the sum
        slack = sum(abs(int(w)) for w in q) * ((1 << self.drop) - 1) >> self.drop
        return members(self.at_least(total, among, self.kth(total, among, k) - slack), len(self.x))

    def best(self, q: np.ndarray, k: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and exact scores of the ``k`` best rows, ties by number."""
        rows = self.candidates(q, k, among)
        scores = inner(q[None, :], self.x[rows])[0]
        order = np.lexsort((rows, -scores))[:k]
        return rows[order], scores[order]


def _search(k: int, slices: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        out = []
        if len(ids) and queries.num_rows:
            index = SlicedIndex(matrix(rows, "x")[order], slices)
            q, own = matrix(queries, "x"), queries.column("id").to_numpy()
            for i, qid in enumerate(queries.column("qid").to_pylist()):
                among = index.rows
                a, b = np.searchsorted(ids, own[i], "left"), np.searchsorted(ids, own[i], "right")
                if b > a:
                    mask = np.ones(len(ids), bool)
                    mask[a:b] = False
                    among = bitmap(mask)
                at, scores = index.best(q[i], k, among)
                out.append((np.full(len(at), qid), scores, ids[at]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_FOUND)
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
          vec_col: str = "embedding", slices: int = SLICES, lane: int = LANE, group: int = GROUP) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row where ``is_query``
    the ``k`` rows of the highest exact inner product of the components times
    ``scale``, rounded down; ties go to the smaller id.

    Defined cases: rows with a null id, or a vector that is null or holds a
    null or non-finite component, take no part; vectors of different lengths
    never meet (empty ones score 0 with each other); a row is no candidate of
    a query of its own id; wholly equal queries are answered once, unlike
    ones of one id each on its own; repeated rows are candidates each; with
    fewer than ``k`` candidates all are returned; an empty table gives an
    empty result; other columns are not read.  A component that takes 62 bits
    or a score beyond a long is an error.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"),
                          F.coalesce(is_query, F.lit(False)).alias("asks")) \
        .where(F.col("id").isNotNull() & whole_vector(F.col("vec")))
    rows = rows.select("id", scaled(F.col("vec"), scale).alias("x"), "asks").withColumn("dim", F.size("x"))
    rows, lanes = dealt(rows, lane, "lane")
    queries, groups = dealt(rows.where("asks").select("id", "dim", "x").distinct(), group, "grp")
    queries = cut_lineage(queries.withColumn("qid", F.monotonically_increasing_id()))
    found = in_units(rows.select("id", "dim", "x", "lane"), lanes, queries, groups, _search(k, slices),
                     "qid bigint, score bigint, id bigint")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.join(queries.select("qid", F.col("id").alias("query_id")), "qid") \
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
