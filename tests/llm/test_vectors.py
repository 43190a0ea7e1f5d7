"""Hard negatives, exact top-k and whitening against brute force."""
from __future__ import annotations

import decimal
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rewardlake.llm import bitslice, negatives, queries, units, whitening

SF = "/root/testdata/sf0.001"
KIND = "vec_id bigint, embedding array<float>, label int, score int, id string, x int, dim int, lane int, grp int, qid int, deviation int, key int"
EXTRA = (1, "a", 2, 3, 4, 5, 6, 7, 8)


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(2).tolist(), int(rng.integers(0, 3))) for i in range(200)]
    same = [0.5, -0.25, 0.125, 1.0, 0.0, -0.0]
    rows += [(200 + i, same, i % 2) for i in range(120)]                       # ties: one vector holds a third of the rows
    rows += [(400, same, 1)] * 3 + [(500, same, 0)] * 2                        # repeated rows, also of a query
    rows += [(600, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 0), (600, [-1.0] * 6, 0)]   # unlike rows of one id
    rows += [(700, None, 0), (701, [1.0, None, 2.0, 3.0, 4.0, 5.0], 0), (702, [float("nan")] * 6, 1),
             (703, [float("inf")] + [0.0] * 5, 1), (800, [0.0] * 6, 1), (None, same, 0), (900, same, None)]
    rows += [(1000, [1.0, 2.0], 0), (1001, [2.0, 1.0], 0), (1002, [2.0, 2.0], 1), (1100, [], 0), (1101, [], 1), (1102, [], 0)]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], KIND).repartition(5)


def _rows(df, scale, label=None):
    out = []
    for r in df.collect():
        v = r["embedding"]
        if r["vec_id"] is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        out.append((r["vec_id"], [math.floor(scale * c) for c in v], r["label"]))
    return out


def _dot(a, b):
    return sum(p * q for p, q in zip(a, b, strict=True))


def _top(df, scale, k):
    rows = _rows(df, scale)
    out = []
    for i, q in sorted({(i, tuple(v)) for i, v, _ in rows if i % 100 == 0}):
        best = sorted((-_dot(q, v), j) for j, v, _ in rows if j != i and len(v) == len(q))[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


def _hard(df, scale, label, pos=5, neg=5, low=80):
    rows = [(i, tuple(v), label(i, c)) for i, v, c in _rows(df, scale) if c is not None]
    out = []
    for i, q, c in sorted({r for r in rows if r[0] % 100 == 0}):
        other = [(-_dot(q, v), j, d) for j, v, d in rows if len(v) == len(q) and j != i]
        for ps, p, _ in sorted(o for o in other if o[2] == c)[:pos]:
            window = sorted((s, j) for s, j, d in [(s, j, d) for s, j, d in
                            [(-_dot(q, v), j, d) for j, v, d in rows if len(v) == len(q)]] if d != c and low * -ps <= 100 * -s <= 100 * -ps)
            out += [(i, p, n, j, -ps, -s) for n, (s, j) in enumerate(window[:neg], 1)]
    return sorted(out)


TOP = ["query_id", "rank", "vec_id", "score"]
HARD = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def _got(df, cols):
    assert set(cols) <= set(df.columns)
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("lane,group", [(1 << 20, 1 << 20), (37, 2)])
def test_top_k_odd_rows(spark, odd, lane, group):
    got = bitslice.top_k(odd, F.col("vec_id") % 100 == 0, k=4, scale=64, slices=3, lane=lane, group=group)
    assert _got(got, TOP) == _top(odd, 64, 4)


@pytest.mark.parametrize("lane,group", [(1 << 20, 1 << 20), (37, 2)])
def test_hard_negatives_odd_rows(spark, odd, lane, group):
    got = negatives.hard_negatives(odd, F.col("vec_id") % 100 == 0, positives=4, negatives=3, low=70, scale=64, lane=lane, group=group)
    assert _got(got, HARD) == _hard(odd, 64, lambda i, c: c, 4, 3, 70)


def test_registered_queries(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert _got(queries.op12_top_k(spark, SF), TOP) == _top(e, 1024, 10)
    want = _hard(e, 256, lambda i, c: (c + 1) % 10 if i % 7 == 0 else c)
    assert want and _got(queries.op11_hard_negatives(spark, SF), HARD) == want


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert bitslice.top_k(none, F.lit(True)).count() == 0
    assert negatives.hard_negatives(none, F.lit(True)).count() == 0
    assert whitening.whiten(none).count() == 0
    nulls = odd.where("vec_id in (700, 701, 702, 703)")
    assert whitening.whiten(nulls).count() == 0 and bitslice.top_k(nulls, F.lit(True)).count() == 0


def test_bit_slices_against_sums():
    rng = np.random.default_rng(5)
    for n, d, size, k in ((1, 3, 5, 2), (63, 4, 9, 3), (64, 1, 300, 64), (129, 7, 1000, 10), (1000, 16, 1 << 28, 25), (50, 5, 1, 5)):
        x, q = rng.integers(-size, size + 1, (n, d)), rng.integers(-size // 3 - 1, size // 3 + 2, d)
        for slices in (1, 4, 64):
            index = bitslice.SlicedIndex(x, slices)
            high = (x - x.min(axis=0)).astype(object) >> index.drop
            most = (1 << index.depth) - 1
            sums = [sum(abs(int(w)) * (int(v) if w >= 0 else most - int(v)) for w, v in zip(q, row, strict=True)) for row in high]
            total = index.add(q)
            bits = [bitslice.members(t, n) for t in total]
            assert [sum(1 << i for i, b in enumerate(bits) if r in b) for r in range(n)] == sums
            among = bitslice.bitmap(np.arange(n) % 3 != 1)
            kept = [r for r in range(n) if r % 3 != 1]
            if len(kept) >= k:
                assert index.kth(total, among, k) == sorted((sums[r] for r in kept), reverse=True)[k - 1]
            for least in (-1, 0, sums[0], max(sums), max(sums) + 1, 1 << 90):
                assert list(bitslice.members(index.at_least(total, among, least), n)) == [r for r in kept if sums[r] >= least]
            at, scores = index.best(q, k, among)
            exact = sorted((-_dot(q.tolist(), x[r].tolist()), r) for r in kept)[:k]
            assert list(zip((-scores).tolist(), at.tolist(), strict=True)) == exact


def test_index_reads_few_rows():
    rng = np.random.default_rng(6)
    x = np.floor(1024 * rng.normal(size=(20000, 32)) / math.sqrt(32)).astype(np.int64)
    index = bitslice.SlicedIndex(x)
    assert np.mean([len(index.candidates(x[i], 10, index.rows)) for i in range(20)]) < 1000


def test_scores_beyond_double_are_exact_or_fail():
    q, x = np.array([[3 ** 19, 1]]), np.array([[3 ** 19, 7], [1 - 3 ** 19, 0]])
    assert units.inner(q, x).tolist() == [[3 ** 38 + 7, 3 ** 19 - 3 ** 38]]
    with pytest.raises(OverflowError):
        units.inner(np.array([[1 << 40]]), np.array([[1 << 40]]))


def test_hot_keys_are_spread(spark):
    """A third of the rows under one label, vector and id: no unit is larger
    than a lane."""
    d = spark.range(6000).select(F.lit(5).cast("bigint").alias("id"), F.array(F.lit(1).cast("bigint")).alias("x"))
    rows, lanes = units.dealt(d, 500, "lane")
    sizes = [r["count"] for r in rows.groupBy("lane").count().collect()]
    assert lanes >= 12 and len(sizes) == lanes and max(sizes) <= 2 * 6000 / lanes


# -- whitening ---------------------------------------------------------------
def _check_whitening(df, scale, got, components=4, least=1e-9):
    rows = [(i, v) for i, v in ((r["vec_id"], r["embedding"]) for r in df.collect())
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    by = {}
    for r in got.collect():
        by.setdefault((r["vec_id"], r["n"], r["deviation"]), []).append(r)
    want = 0
    for dim in {len(v) for _, v in rows} - {0}:
        x = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if len(v) == dim]
        fit = np.array(sorted({tuple(v) for _, v in x}))
        n, sums = len(fit), fit.sum(axis=0)
        cov = np.cov(fit.T.astype(float), bias=True).reshape(dim, dim)
        e, u = np.linalg.eigh(cov)
        e, u = e[::-1][:components], u[:, ::-1][:, :components]
        for c in range(min(components, dim)):
            if e[c] < least:
                continue
            gap = min((abs(e[c] - o) for k, o in enumerate(np.linalg.eigvalsh(cov)[::-1]) if k != c), default=1)
            sign = set()
            for i, v in x:
                want += 1
                dev = sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums, strict=True))
                r = next(r for r in by[(i, n, dev)] if r["component"] == c + 1)
                assert abs(r["explained"] - e[c] / np.trace(cov)) < 1e-9 and r["identity_error"] < 1e-9
                if gap > 1e-6 * e[0]:
                    y = (np.array(v) - sums / n) @ u[:, c] / math.sqrt(e[c])
                    if abs(y) > 1e-6:
                        sign.add(round(r["whitened"] / y, 6))
            assert len(sign) <= 1 and all(abs(s) == 1 for s in sign)
    assert got.count() == want


def test_whitening_query(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    d = queries.op13_whitening(spark, SF)
    assert dict(d.dtypes) | {} == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
                                   "whitened": "double", "explained": "double", "identity_error": "double"}
    _check_whitening(e, 256, d)


def test_whitening_odd_rows(spark, odd):
    _check_whitening(odd, 64, whitening.whiten(odd, scale=64))


def test_whitening_repeated_roots(spark):
    """The corners of a cube: every component has the same eigenvalue."""
    rows = [(i, [float(2 * (i >> b & 1) - 1) for b in range(3)], 0) for i in range(8)] + [(9, [1.0, 1.0, 1.0], 0)]
    d = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), scale=1)
    got = d.collect()
    assert len(got) == 27 and {r["n"] for r in got} == {8}
    assert all(abs(r["explained"] - 1 / 3) < 1e-12 and r["identity_error"] < 1e-12 for r in got)
    one = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    y = np.array([[one[(i, c)] for c in (1, 2, 3)] for i in range(8)])
    assert np.abs(y.T @ y / 8 - np.eye(3)).max() < 1e-12


def test_flat_vectors_have_no_components(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(5)]
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).count() == 0
    rows = [(i, [float(i), float(2 * i)], 0) for i in range(5)]     # one direction only
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), scale=1).collect()
    assert [r["component"] for r in got] == [1] * 5 and all(abs(r["explained"] - 1) < 1e-15 for r in got)


def _leibniz(m):
    """det(t - m) by the Faddeev-LeVerrier recurrence in exact integers."""
    n = len(m)
    a, c, k = np.array(m, object), [1], np.zeros((n, n), object)
    for i in range(1, n + 1):
        k = a @ k + c[-1] * np.eye(n, dtype=int).astype(object)
        c.append(-int(np.trace(a @ k)) // i)
    return c[::-1]


def test_characteristic_polynomial_is_exact(spark):
    rng = np.random.default_rng(8)
    for n, size in ((1, 5), (2, 3), (5, 100), (9, 10 ** 6), (12, 10 ** 12)):
        b = rng.integers(-size, size + 1, (n, n)).astype(object)
        if n == 9:
            b[:, 3] = b[:, 5] = 0
        m = (b @ b.T).tolist()
        assert whitening.characteristic_polynomial(spark, [[int(v) for v in r] for r in m]) == _leibniz(m)


def test_polynomial_modulo_primes():
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 7):
        for p in (2, 3, 101, 2147483647):
            m = rng.integers(0, p, (n, n))
            m[n // 2:, 0] = 0                                       # pivots to look for
            assert whitening.charpoly_mod(m, p).tolist() == [c % p for c in _leibniz(m.tolist())]


def test_roots_with_their_multiplicity():
    roots, poly = [0, 3, 3, 3, 7, 10, 10], [1]
    for r in roots:
        poly = [(poly[i - 1] if i else 0) - r * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    assert [whitening.roots_above(poly, a) for a in (-1, 0, 2, 3, 9, 10)] == [7, 6, 6, 3, 2, 0]
    for bits in (0, 5, 60):
        for nth, (root, above, within) in enumerate([(10, 0, 2)] * 2 + [(7, 2, 1)] + [(3, 3, 3)] * 3, 1):
            assert whitening.nth_root(poly, nth, 40, bits) == ((root << bits) - 1, above, within)
        assert whitening.nth_root(poly, 7, 40, bits)[0] == -1


def test_null_space_of_close_roots():
    m = [[10 ** 20 + 1, 1, 0], [1, 10 ** 20 + 1, 0], [0, 0, 10 ** 20]]
    poly = _leibniz(m)
    got = [whitening.component(m, poly, i) for i in (1, 2, 3)]
    assert [g[0] for g in got] == [float(10 ** 20 + 2), 1e20, 1e20]
    basis = np.array([g[1] for g in got])
    assert np.abs(basis @ basis.T - np.eye(3)).max() < 1e-15 and np.abs(basis[0] - [math.sqrt(0.5), math.sqrt(0.5), 0]).max() < 1e-15


def test_moments_of_large_numbers(spark):
    rows = [(2, [3 * 10 ** 9, -1]), (2, [-5, 10 ** 9]), (1, [7])]
    got = whitening.moments(spark.createDataFrame(rows, "dim int, x array<bigint>").repartition(3))
    assert got == {2: (2, [3 * 10 ** 9 - 5, 10 ** 9 - 1], [[9 * 10 ** 18 + 25, -8 * 10 ** 9], [-8 * 10 ** 9, 10 ** 18 + 1]]),
                   1: (1, [7], [[49]])}
    w = whitening.Whitener(10 ** 6, (0, 0), ((1.0, (1.0, 0.0)),), 1.0)
    deviation, y = whitening.whiten_rows(np.array([[3 * 10 ** 6, 4]]), w)
    assert deviation == [10 ** 12 * (9 * 10 ** 12 + 16)] and y.tolist() == [[3e6]]
    assert decimal.Decimal(deviation[0]) < decimal.Decimal(10) ** 38
