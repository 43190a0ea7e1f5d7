"""Near-duplicate embeddings with spherical-cap filters.

A filter direction is the concatenation of one codeword from each block of a
random product code on the rotated space; a vector passes the filters whose
inner product with it reaches the threshold, and a list decoder finds them
block by block, dropping prefixes that cannot reach it any more.  Vectors
that share a label and a filter are compared in double precision.

The code is planned from the number of vectors of the largest label, by one
formula for every size: caps hold ``CAP`` vectors or a ``SHARE`` of them, and
there are so many independent rotations that a pair at the threshold shares no
filter with a chance of at most ``MISS``, from the share of simulated pairs
that miss in one rotation.  A vector that passes fewer than ``LEAST`` filters
posts none; it is compared with all of its label instead, in blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_by_value
from .blocks import bucket_units, on_keys
from .common import cut_lineage
from .components import connected_components

ship_by_value(__name__)

#: vectors a cap should hold, or share of a label if that is less, members of a block of a bucket
CAP, SHARE, BLOCK = 256, 1 / 16, 1024
#: filters below which a vector is compared with its whole label
LEAST = 3
#: chance that a pair at the threshold shares no filter, rotations at most (caps grow first), pairs simulated
MISS, ROTATIONS, PAIRS = 0.001, 64, 4000
#: vectors decoded at once
PIECE = 256


@dataclass(frozen=True)
class Code:
    """``rotations`` product codes of ``blocks`` blocks of ``words`` unit
    codewords; ``threshold`` on the inner product of unit vectors."""
    rotations: int
    blocks: int
    words: int
    threshold: float
    seed: int = 1

    def books(self, dim: int):
        """For every rotation: the matrix and each block's (slice, codewords)."""
        out = []
        for r in range(self.rotations):
            rng = np.random.default_rng([self.seed, r, dim, self.blocks, self.words])
            q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
            cuts = np.linspace(0, dim, min(self.blocks, dim) + 1).astype(int)
            parts = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                c = rng.standard_normal((self.words, b - a))
                parts.append((slice(a, b), c / np.linalg.norm(c, axis=1, keepdims=True)))
            out.append((q, parts))
        return out


def cap_threshold(share: float, dim: int) -> float:
    """The inner product that a random unit vector has with a fixed one, or a
    larger one, with chance ``share``."""
    angle = np.linspace(0, math.pi, 200_001)
    mass = np.cumsum(np.sin(angle) ** (dim - 2)) if dim > 2 else angle
    return math.cos(np.interp(share, mass / mass[-1], angle))


def miss_rate(code: Code, dim: int, cosine: float, pairs: int = PAIRS, draws: int = 16) -> tuple[float, float]:
    """Share of random pairs at ``cosine`` that share no filter of ``code``,
    over several draws of it, and the filters a vector passes on average."""
    rng = np.random.default_rng([code.seed, dim])
    missed = hits = 0
    for draw in range(draws):
        u, v = rng.standard_normal((2, pairs // draws, dim))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        v -= (u * v).sum(axis=1, keepdims=True) * u
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        v = cosine * u + math.sqrt(max(0.0, 1 - cosine * cosine)) * v
        one = Code(code.rotations, code.blocks, code.words, code.threshold, code.seed + 1 + draw)
        books = one.books(dim)
        for a, b in zip(decode(u, one, books), decode(v, one, books), strict=True):
            hits += len(a)
            missed += not len(np.intersect1d(a, b, assume_unique=True))
    return missed / (pairs // draws * draws), hits / (pairs // draws * draws)


def plan_code(rows: int, dim: int, cosine: float, miss: float = MISS) -> Code | None:
    """Parameters for ``rows`` vectors a label (see the module's text), or
    None where no code can tell vectors apart (one dimension, a threshold of
    0 or less).  A rotation has so many filters that a pair shares about one
    on average; caps are widened until ``ROTATIONS`` are enough.  Rotations
    are drawn alike and on their own, so a pair misses all with the power of
    the chance to miss one, whatever the data; the chance is taken two
    standard errors high."""
    normal = NormalDist()
    cosine, share = min(cosine, 1 - 1e-9), min(SHARE, CAP / max(rows, 1))
    while dim > 1 and cosine > 0 and share < 0.5:
        a = normal.inv_cdf(1 - share)
        xs = np.linspace(a, a + 6, 2001)
        density = np.exp(-xs * xs / 2) / math.sqrt(2 * math.pi)
        tail = np.array([1 - normal.cdf((a - cosine * x) / math.sqrt(1 - cosine * cosine)) for x in xs])
        filters = 1 / max(float((density * tail).sum() * (xs[1] - xs[0])), 1e-12)
        blocks = min(dim, max(2, math.ceil(math.log(filters) / math.log(1 << 20))))
        words = max(2, math.ceil(filters ** (1 / blocks)))
        threshold = cap_threshold(share, dim)
        lost, _ = miss_rate(Code(1, blocks, words, threshold), dim, cosine)
        lost += 2 * math.sqrt(lost * (1 - lost) / PAIRS) + 1 / PAIRS
        rotations = math.ceil(math.log(miss) / math.log(lost)) if lost < 1 else ROTATIONS + 1
        if rotations <= ROTATIONS:
            return Code(rotations, blocks, words, threshold)
        share *= 2
    return None


def decode(unit: np.ndarray, code: Code, books) -> list[np.ndarray]:
    """For every row of ``unit`` (unit vectors) the ascending ids of the
    filters it passes."""
    rows, ids = [], []
    first = 0
    for q, parts in books:
        y = unit @ q
        scale = 1 / math.sqrt(len(parts))
        scores = [(y[:, at] @ c.T) * scale for at, c in parts]
        best_rest = [0.0] * len(parts)
        tail = np.zeros(len(unit))
        for k in range(len(parts) - 1, -1, -1):
            best_rest[k] = tail
            tail = tail + scores[k].max(axis=1)
        at, word, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, s in enumerate(scores):
            reach = total[:, None] + s[at]
            i, w = np.nonzero(reach >= (code.threshold - best_rest[k][at])[:, None])
            at, word, total = at[i], word[i] * code.words + w, reach[i, w]
        rows.append(at)
        ids.append(first + word)
        first += code.words ** len(parts)
    row, fid = np.concatenate(rows), np.concatenate(ids)
    order = np.lexsort((fid, row))
    row, fid = row[order], fid[order]
    return np.split(fid, np.searchsorted(row, np.arange(1, len(unit))))


def _postings(codes: dict[int, Code | None], least: int):
    """A row for every filter that a vector passes; one with filter -1 for a
    vector that passes fewer than ``least``."""
    def run(batches):
        books = {}
        for batch in batches:
            for s in range(0, batch.num_rows, PIECE):
                part = batch.slice(s, PIECE)
                vecs = part.column("vec").to_pylist()
                by_dim: dict[int, list[int]] = {}
                for i, v in enumerate(vecs):
                    by_dim.setdefault(len(v), []).append(i)
                for dim, at in by_dim.items():
                    x = np.array([vecs[i] for i in at], np.float64)
                    hits = [np.zeros(0, np.int64)] * len(at)
                    if codes[dim]:
                        if dim not in books:
                            books[dim] = codes[dim].books(dim)
                        hits = decode(x / np.linalg.norm(x, axis=1, keepdims=True), codes[dim], books[dim])
                    hits = [h if len(h) >= least else np.array([-1]) for h in hits]
                    rows = part.take(pa.array(np.repeat(np.array(at), [len(h) for h in hits])))
                    lists = [h for h in hits for _ in range(len(h))]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("label"), pa.array(np.full(len(lists), dim, np.int32)),
                         pa.array(np.concatenate(hits)), rows.column("cid"), rows.column("copies"),
                         rows.column("vec"), pa.array(lists, pa.list_(pa.int64()))],
                        ["label", "dim", "filter", "cid", "copies", "vec", "filters"])
    return run


def unit_links(x: np.ndarray, ids: np.ndarray, copies: np.ndarray, chunk: np.ndarray, filters: list, fid: int,
               cross: bool, cosine: float):
    """Per member of a unit: how many vectors it links with (each pair only
    in the smallest filter it shares) and its parent in a spanning forest of
    the unit's links.  In a unit of two blocks only pairs across count."""
    n = len(ids)
    norm = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / (norm[:, None] * norm[None, :]) >= cosine
    np.fill_diagonal(near, False)
    if cross:
        near &= chunk[:, None] != chunk[None, :]
    busy = np.nonzero(near.any(axis=1))[0]
    if not len(busy):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    near, where = near[np.ix_(busy, busy)], {int(b): k for k, b in enumerate(busy)}
    seen: dict[int, list[int]] = {}
    for b in busy:
        for f in filters[b]:
            if f >= fid:
                break
            seen.setdefault(f, []).append(where[int(b)])
    shared = [m for m in seen.values() if len(m) > 1]
    counted = near
    if shared:
        member = np.zeros((len(busy), len(shared)), np.float32)
        for k, m in enumerate(shared):
            member[m, k] = 1
        counted = near & (member @ member.T == 0)
    links = counted.astype(np.int64) @ copies[busy]
    parent = np.full(len(busy), -1)
    left = np.ones(len(busy), bool)
    for root in range(len(busy)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            at = queue.pop()
            hit = np.nonzero(near[at] & left)[0]
            parent[hit], left[hit] = at, False
            queue += hit.tolist()
    own = ids[busy]
    return own, links, np.where(parent >= 0, own[parent], own)


def _verify(cosine: float):
    schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("parent", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim = table.column("dim")[0].as_py()
        x = np.asarray(table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
        col = lambda c: table.column(c).to_numpy()
        out = unit_links(x, col("cid"), col("copies"), col("_c"), table.column("filters").to_pylist(),
                         table.column("filter")[0].as_py(), table.column("_i")[0].as_py() != table.column("_j")[0].as_py(), cosine)
        return pa.Table.from_arrays([pa.array(o, pa.int64()) for o in out], schema=schema)
    return run


def _search(cosine: float):
    """Links of the vectors without filters (right) with a block of their
    label (left): a link of two of them is counted for each from its own
    side, any other one for both here."""
    schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("parent", pa.int64())])

    def matrix(table: pa.Table) -> np.ndarray:
        flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = flat.reshape(table.num_rows, -1)
        return x, np.linalg.norm(x, axis=1)

    def run(rows: pa.Table, few: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)] * 3]
        if rows.num_rows and few.num_rows:
            (x, nx), (y, ny) = matrix(rows), matrix(few)
            ids, mine = rows.column("cid").to_numpy(), few.column("cid").to_numpy()
            copies, own = rows.column("copies").to_numpy(), few.column("copies").to_numpy()
            alone = rows.column("few").to_numpy(zero_copy_only=False).astype(bool)
            parent, links = np.full(len(x), -1), np.zeros(len(x), np.int64)
            for s in range(0, len(y), PIECE):
                part = slice(s, s + PIECE)
                near = (y[part] @ x.T) / (ny[part, None] * nx[None, :]) >= cosine
                near &= mine[part, None] != ids[None, :]
                links += np.where(alone, 0, own[part] @ near.astype(np.int64))
                up = mine[part].copy()
                for k, hit in enumerate(near):
                    # an edge to a row that another vector has reached, and from each row not reached yet
                    known = np.nonzero(hit & (parent >= 0))[0]
                    if len(known):
                        up[k] = ids[known[0]]
                    parent[hit & (parent < 0)] = mine[s + k]
                out.append([mine[part], near.astype(np.int64) @ copies, up])
            met = parent >= 0
            out.append([ids[met], links[met], parent[met]])
        return pa.Table.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], schema=schema)
    return run


def _whole_label(members: DataFrame, postings: DataFrame, cosine: float, block: int) -> DataFrame:
    """Links of the vectors without filters, each compared with its label in
    blocks of ``block`` rows by ``block`` such vectors."""
    none = postings.where(F.col("filter") < 0).select("label", "dim", "cid", "copies", "vec")
    size = none.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("_few"))
    rows = on_keys(members, size, ["label", "dim"])                # labels that have such vectors
    n = members.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("_all"))
    none = on_keys(none, on_keys(n, size, ["label", "dim"]), ["label", "dim"])
    part = lambda salt, of: F.pmod(F.xxhash64("cid", F.lit(salt)), F.ceil(F.col(of) / block)).cast("int")
    to = lambda of: F.explode(F.sequence(F.lit(0), F.ceil(F.col(of) / block).cast("int") - 1))
    rows = on_keys(rows, n, ["label", "dim"]).withColumn("_i", part(3, "_all")).withColumn("_j", to("_few"))
    none = none.withColumn("_j", part(4, "_few")).withColumn("_i", to("_all"))
    marked = rows.join(postings.where(F.col("filter") < 0).select(F.col("cid").alias("_cid")), F.col("cid") == F.col("_cid"), "left") \
        .withColumn("few", F.col("_cid").isNotNull())
    key = ["label", "dim", "_i", "_j"]
    side = lambda d, *more: d.select(*[F.col(c).alias(c) for c in (*key, "cid", "copies", "vec", *more)])
    return side(marked, "few").groupBy(*key).cogroup(side(none).groupBy(*key)) \
        .applyInArrow(_search(cosine), "cid bigint, links bigint, parent bigint")


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "label", code: Code | None = None, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """``<id>, n_links, component_id, kept`` for every row.

    Two vectors link if their labels are equal and not null and their cosine
    in double precision is at least ``cosine``.  Defined cases: vectors that
    are null, empty, all zero or hold null or non-finite components, and rows
    with a null label, link with nothing; vectors of different lengths never
    link; equal vectors are one class (each links with all others of it), so
    copies are never expanded into pairs; rows with a null id count as links
    of others, hold components together and get their component's id, the
    smallest of its rows' that is not null; unlike vectors of one id are
    judged each on its own; an empty table gives an empty result; other
    columns are not read.  Compared are vectors that share a filter of
    ``code`` (if not given: one planned for the length's largest label), and
    one that passes fewer than ``least`` filters with all of its label.
    """
    rows = vectors.select(F.col(id_col), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    usable = F.col("label").isNotNull() & F.coalesce(
        F.forall("vec", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
        & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = cut_lineage(rows.withColumn("vec", F.when(usable, F.transform("vec", lambda v: v + F.lit(0.0)))))
    classes = rows.where(F.col("vec").isNotNull()).groupBy("label", "vec").agg(
        F.min(id_col).alias("name"), F.count(F.lit(1)).alias("copies"))
    # the checkpoint fixes the classes' own ids
    classes = cut_lineage(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")))
    members = classes.select("label", "dim", "cid", "copies", "vec")
    # a row for every vector length comes to the driver
    most = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()
    codes = {r["dim"]: code or plan_code(r["n"], r["dim"], cosine) for r in most}
    kind = dict(classes.dtypes)["label"]
    postings = cut_lineage(members.mapInArrow(
        _postings(codes, least), f"label {kind}, dim int, filter bigint, cid bigint, copies bigint, vec array<double>, filters array<bigint>"))
    units = bucket_units(postings.where(F.col("filter") >= 0), ["label", "dim", "filter"], "cid", block)
    found = units.groupBy("label", "dim", "filter", "_i", "_j").applyInArrow(_verify(cosine), "cid bigint, links bigint, parent bigint")
    found = cut_lineage(found.unionByName(_whole_label(members, postings, cosine, block)))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = connected_components(found.where(F.col("cid") != F.col("parent")), "cid", "parent")
    joined = classes.join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("component", "cid"))
    # a component is called after the smallest id of its rows
    names = joined.groupBy("root").agg(F.min("name").alias("component_id"))
    named = on_keys(joined.join(links, "cid", "left"), names, ["root"]).select(
        "label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(named, ["label", "vec"], "left")
    component = F.coalesce("component_id", F.col(id_col))
    return out.select(F.col(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"), (F.col(id_col).eqNullSafe(component)).alias("kept"))
