"""SimHash near-duplicates through a byte-position inverted index.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of
their 8 positional bytes.  The index posts each distinct fingerprint under
sets of positional bytes chosen so that any 5 shared ones include a posted
set; members of a bucket tally the positional bytes they share, pairs below
the guaranteed minimum are dropped, and the rest are verified bit by bit.

Buckets are cut into bounded units, and a unit passes on a spanning forest
of its links, never all pairs, so a large group of near copies costs one
edge a member and unit.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..shipping import ship_by_value
from .blocks import bucket_units, on_keys
from .common import cut_lineage
from .components import connected_components

ship_by_value(__name__)

SEED, BITS, BYTES = 42, 64, 8
#: members of a block of a bucket
BLOCK = 2048
#: shingles whose bits are unpacked at once
PIECE = 1 << 16
#: positional bytes of a posted set (n fingerprints meet one by chance in about n / 2^21 places; blocks bound the work)
POSTED = 3


def text_fingerprint(text: bytes | None, words: int) -> int:
    """Signed 64-bit SimHash of a text's word shingles (repeats count)."""
    import xxhash

    w = (text or b"").lower().split()  # of bytes: A-Z and ASCII white space only
    if not w:
        return 0
    if len(w) < words:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    n = max(1, len(w) - words + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for s in range(0, n, PIECE):
        part = h[s:s + PIECE].view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, words: int) -> Column:
    @arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([text_fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, words)
                         for t in texts], pa.int64())
    return of(text)


def index_sets(min_shared: int, size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` byte positions such that every ``min_shared``
    positions of the 8 include one of them: with size 3 of 5, the triples
    inside either half of the fingerprint (5 positions put 3 in one half);
    else all sets of that size."""
    if size == 3 and min_shared >= 5:
        return [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
    return list(combinations(range(BYTES), size))


def _posting_keys(fp: Column, sets: list[tuple[int, ...]]) -> Column:
    def key(n: int, positions: tuple[int, ...]) -> Column:
        out = F.lit(n).cast("bigint")
        for p in positions:
            out = out * 256 + F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("bigint"))
        return out
    return F.array(*[key(n, s) for n, s in enumerate(sets)])


def unit_forest(fps: np.ndarray, ids: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Tree edges (ids) of the links among a unit's fingerprints.  Each
    member in turn tallies the positional bytes it shares with those not
    reached yet, keeps pairs at the guaranteed minimum and verifies them."""
    edges: list[tuple[int, int]] = []
    left = np.arange(len(fps))
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
            continue
        at = queue.pop()
        x = fps[left] ^ fps[at]
        shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        near = (shared >= BYTES - max_bits) & (np.bitwise_count(x) <= max_bits)
        if near.any():
            hit = left[near]
            edges += [(int(ids[at]), int(ids[k])) for k in hit]
            queue += hit.tolist()
            left = left[~near]
    return edges


def _forest_udf(max_bits: int):
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    @arrow_udf("array<struct<a:bigint,b:bigint>>")
    def forest(fps: pa.Array) -> pa.Array:
        out = []
        for one in fps:
            f = np.asarray(one.values.to_numpy(zero_copy_only=False), np.int64)
            out.append([{"a": a, "b": b} for a, b in unit_forest(f.view(np.uint64), f, max_bits)])
        return pa.array(out, kind)
    return forest


def fingerprint_components(prints: DataFrame, max_bits: int = 3, id_col: str = "doc_id",
                           fp_col: str = "fingerprint", block: int = BLOCK) -> DataFrame:
    """Add ``component_id``: the smallest id reachable over links of at most
    ``max_bits`` differing bits.  ``prints`` should be cheap to read twice.

    The nodes are the fingerprints themselves, named by ids only at the end:
    rows without an id hold their component together like any other, and
    unlike rows that share an id are judged each on its own.  A component
    without any id has none.
    """
    fp = F.col(fp_col)
    classes = cut_lineage(prints.where(fp.isNotNull()).groupBy(fp.alias("_fp")).agg(F.min(id_col).alias("_id")))
    sets = index_sets(BYTES - max_bits, min(POSTED, BYTES - max_bits))
    postings = classes.select("_fp", F.explode(_posting_keys(F.col("_fp"), sets)).alias("_key"))
    units = bucket_units(postings, ["_key"], "_fp", block)
    lists = units.groupBy("_key", "_i", "_j").agg(F.collect_list("_fp").alias("m"))
    found = connected_components(lists.select(F.inline(_forest_udf(max_bits)(F.col("m")))))
    joined = classes.join(found, classes["_fp"] == found["node"], "left") \
                    .select("_fp", "_id", F.coalesce("component", "_fp").alias("_root"))
    names = joined.groupBy("_root").agg(F.min("_id").alias("component_id"))
    named = on_keys(joined, names, ["_root"]).select("_fp", "component_id")
    # rows of one fingerprint may be many
    return on_keys(prints, named.withColumnRenamed("_fp", fp_col), [fp_col], "left")


def simhash_components(docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``<id>, fingerprint (bigint), component_id`` for every row.

    Defined cases: null, empty and white-space texts have fingerprint 0 and
    link like any other; texts of fewer than ``words`` words are one shingle;
    repeated rows share a class; null ids get their component's id (null if
    no row of it has one) and hold it together; unlike texts of one id are
    judged each on its own; an empty table gives an empty result; other
    columns are not read.
    """
    prints = docs.select(F.col(id_col), fingerprint(F.col(text_col), words).alias("fingerprint"))
    return fingerprint_components(cut_lineage(prints), max_bits, id_col)
