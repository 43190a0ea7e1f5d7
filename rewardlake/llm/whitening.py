"""Whitening of integer vectors through the exact characteristic polynomial.

With ``n`` distinct integer vectors, sums ``S`` and ``G`` the sum of outer
products, ``M = n G - S S'`` is the integer scatter: ``n * n`` times the
covariance.  Its characteristic polynomial is computed modulo many primes
(reduction to Hessenberg form, one prime a row of a Spark job) and put
together by Chinese remaindering.  All its roots are real and none is
negative, so Descartes' rule of signs is exact: the sign changes of the
polynomial shifted by ``a`` count the roots above ``a`` with their
multiplicity, and bisection isolates and refines each root to any precision.
Inverse iteration in decimal arithmetic gives the null space of ``M - root``;
a repeated root gets an orthonormal basis of it.
"""

from __future__ import annotations

import decimal
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_by_value
from .common import cut_lineage
from .units import matrix, scaled, whole_vector

ship_by_value(__name__)

#: bits of a root's fraction, decimal digits of the inverse iteration beyond those of the root
FRACTION, DIGITS = 96, 40
#: primes lie just below this: their products fit a signed long
PRIME_TOP = 1 << 31
#: rows worked on at once
PIECE = 4096


# -- moments -----------------------------------------------------------------
def exact_gram(x: np.ndarray) -> np.ndarray:
    """Sum of the outer products of integer rows, as Python integers."""
    top = int(np.abs(x).max(initial=0))
    if top * top * max(1, len(x)) < 1 << 53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def _moments(batches):
    """Sums and sums of products of a task's rows, one row an entry."""
    held: dict[int, list] = {}
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        dims = table.column("dim").to_numpy()
        for dim in np.unique(dims):
            x = matrix(table.filter(pa.array(dims == dim)), "x")
            got = held.setdefault(int(dim), [0, np.zeros(dim, object), np.zeros((dim, dim), object)])
            got[0] += len(x)
            for s in range(0, len(x), PIECE):
                got[1] += x[s:s + PIECE].astype(object).sum(axis=0)
                got[2] += exact_gram(x[s:s + PIECE])
    for dim, (n, sums, gram) in held.items():
        i, j = np.triu_indices(dim)
        # row -1 holds the number of vectors, then the sums, then the products
        ii = np.concatenate([[-1], np.full(dim, -1), i])
        jj = np.concatenate([[-1], np.arange(dim), j])
        values = [n, *sums.tolist(), *gram[i, j].tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ii), dim, np.int32)), pa.array(ii, pa.int32()), pa.array(jj, pa.int32()),
             pa.array([decimal.Decimal(int(v)) for v in values], pa.decimal128(38, 0))], ["dim", "i", "j", "v"])


def moments(fit: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """By vector length: number, sums and sums of products.  Tasks give one
    partial sum an entry; the driver gets the ``dim * dim`` totals."""
    parts = fit.select("dim", "x").mapInArrow(_moments, "dim int, i int, j int, v decimal(38,0)")
    out: dict = {}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():
        if r["v"] is None:
            raise OverflowError("a sum of products has over 38 digits")
        got = out.setdefault(r["dim"], [0, [0] * r["dim"], [[0] * r["dim"] for _ in range(r["dim"])]])
        if r["i"] < 0:
            if r["j"] < 0:
                got[0] = int(r["v"])
            else:
                got[1][r["j"]] = int(r["v"])
        else:
            got[2][r["i"]][r["j"]] = got[2][r["j"]][r["i"]] = int(r["v"])
    return {dim: tuple(got) for dim, got in out.items()}


# -- characteristic polynomial -----------------------------------------------
def is_prime(n: int) -> bool:
    """Miller-Rabin, exact below 3,215,031,751."""
    if n < 2 or n % 2 == 0:
        return n == 2
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):
        if a % n == 0:
            continue
        y = pow(a, d, n)
        if y in (1, n - 1):
            continue
        for _ in range(s - 1):
            y = y * y % n
            if y == n - 1:
                break
        else:
            return False
    return True


def primes_below(top: int, bits: int) -> list[int]:
    """The largest primes below ``top`` whose product has over ``bits`` bits."""
    out, size, at = [], 0.0, top - 1
    while size <= bits:
        if is_prime(at):
            out.append(at)
            size += math.log2(at)
        at -= 2 if at % 2 else 1
    return out


def hessenberg_mod(m: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``m`` modulo ``p`` that is zero below the first
    subdiagonal."""
    h = m % p
    n = len(h)
    for k in range(n - 2):
        below = np.nonzero(h[k + 1:, k])[0]
        if not len(below):
            continue
        at = k + 1 + int(below[0])
        if at != k + 1:
            h[[k + 1, at]] = h[[at, k + 1]]
            h[:, [k + 1, at]] = h[:, [at, k + 1]]
        factor = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factor[:, None] * h[k + 1][None, :] % p) % p
        # the inverse operation on columns, in halves so that a sum of products stays in a long
        high, low = factor >> 16, factor & 0xFFFF
        add = ((h[:, k + 2:] * high % p).sum(axis=1) % p * 65536 + (h[:, k + 2:] * low % p).sum(axis=1)) % p
        h[:, k + 1] = (h[:, k + 1] + add) % p
    return h


def charpoly_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t - m) modulo ``p``, constant term first."""
    h = hessenberg_mod(m, p)
    n = len(h)
    polys = [np.zeros(n + 1, np.int64) for _ in range(n + 1)]
    polys[0][0] = 1
    for k in range(1, n + 1):
        now = np.roll(polys[k - 1], 1)
        now = (now - polys[k - 1] * int(h[k - 1, k - 1]) % p) % p
        chain = 1
        for i in range(1, k):
            chain = chain * int(h[k - i, k - i - 1]) % p
            if not chain:
                break
            now = (now - polys[k - i - 1] * (chain * int(h[k - i - 1, k - 1]) % p) % p) % p
        polys[k] = now
    return polys[n]


def _residues(m: list[list[int]]):
    def run(batches):
        whole = np.array(m, object)
        for batch in batches:
            primes = batch.column("prime").to_pylist()
            polys = [charpoly_mod((whole % p).astype(np.int64), p).tolist() for p in primes]
            yield pa.RecordBatch.from_arrays([pa.array(primes, pa.int64()), pa.array(polys, pa.list_(pa.int64()))], ["prime", "poly"])
    return run


def remainder_tree(residues: list[list[int]], primes: list[int]) -> list[int]:
    """Chinese remaindering of every position, pairing neighbours until one
    is left; results lie around zero."""
    level = [(p, [int(v) for v in r]) for p, r in zip(primes, residues, strict=True)]
    while len(level) > 1:
        nxt = []
        for (a, x), (b, y) in zip(level[::2], level[1::2], strict=False):
            inv = pow(a, -1, b)
            nxt.append((a * b, [u + a * ((v - u) * inv % b) for u, v in zip(x, y, strict=True)]))
        if len(level) % 2:
            nxt.append(level[-1])
        level = nxt
    whole, values = level[0]
    return [v - whole if v > whole // 2 else v for v in values]


def coefficient_bits(trace: int, dim: int) -> int:
    """Bits of the largest coefficient for a matrix without negative
    eigenvalues: by Maclaurin the k-th is at most C(dim, k) (trace / dim)^k."""
    top = max(math.comb(dim, k) * (trace // dim + 1) ** k for k in range(dim + 1))
    return top.bit_length() + 2


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Exact coefficients of det(t - m), constant term first, for a symmetric
    integer matrix without negative eigenvalues.  One prime more than the
    bound asks for checks the result."""
    dim = len(m)
    bits = coefficient_bits(sum(m[i][i] for i in range(dim)), dim)
    primes = primes_below(PRIME_TOP, bits + 31)
    tasks = max(1, min(len(primes), 4 * spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "prime bigint").repartition(tasks)
    got = {r["prime"]: r["poly"] for r in rows.mapInArrow(_residues(m), "prime bigint, poly array<bigint>").collect()}
    *used, check = primes
    poly = remainder_tree([got[p] for p in used], used)
    if [c % check for c in poly] != got[check]:
        raise ArithmeticError("the characteristic polynomial does not agree with the checking prime")
    return poly


# -- roots -------------------------------------------------------------------
def shifted(poly: list[int], a: int) -> list[int]:
    """Coefficients of poly(t + a)."""
    out = list(poly)
    for i in range(len(out) - 1):
        for j in range(len(out) - 2, i - 1, -1):
            out[j] += a * out[j + 1]
    return out


def roots_above(poly: list[int], a: int) -> int:
    """Roots above ``a`` of a polynomial that has only real roots, with their
    multiplicity."""
    signs = [c > 0 for c in shifted(poly, a) if c]
    return sum(x != y for x, y in itertools.pairwise(signs))


def nth_root(poly: list[int], nth: int, top: int, bits: int) -> tuple[int, int, int]:
    """The ``nth`` largest root (from 1) of a monic polynomial that has only
    real roots from 0 to ``top``: ``(low, above, within)``, where the root
    times 2^bits lies in (low, low + 1], ``above`` roots lie above that and
    ``within`` in it.  ``low`` is -1 for a root 0."""
    wide = [c << bits * (len(poly) - 1 - i) for i, c in enumerate(poly)]
    low, high = -1, (top << bits) + 1
    n_low, n_high = len(poly) - 1, 0
    while high - low > 1 and n_low - n_high > 1:
        mid = (low + high) // 2
        n = roots_above(wide, mid)
        if n >= nth:
            low, n_low = mid, n
        else:
            high, n_high = mid, n
    # a single root in (low, high]: its sign change is enough
    def at(a: int) -> int:
        value = 0
        for c in reversed(wide):
            value = value * a + c
        return value
    if high - low > 1:
        rising = n_high % 2 == 0
        while high - low > 1:
            mid = (low + high) // 2
            value = at(mid)
            if value == 0 or (value > 0) == rising:
                high = mid
            else:
                low = mid
    return low, n_high, n_low - n_high


# -- null space --------------------------------------------------------------
def _factor(m: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """LU factors of a matrix of decimals in place, rows exchanged for the
    largest pivot; a zero pivot becomes one unit in the last place."""
    a, n, swaps = m.copy(), len(m), []
    tiny = max((abs(v) for v in a.flat), default=decimal.Decimal(1)).scaleb(-decimal.getcontext().prec) or decimal.Decimal(1)
    for k in range(n):
        at = k + max(range(n - k), key=lambda i: abs(a[k + i, k]))
        swaps.append(at)
        if at != k:
            a[[k, at]] = a[[at, k]]
        if not a[k, k]:
            a[k, k] = tiny
        if k + 1 < n:
            a[k + 1:, k] = a[k + 1:, k] / a[k, k]
            a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k, k + 1:])
    return a, swaps


def _solve(lu: np.ndarray, swaps: list[int], b: np.ndarray) -> np.ndarray:
    y = b.copy()
    for k, at in enumerate(swaps):
        if at != k:
            y[[k, at]] = y[[at, k]]
    for k in range(1, len(y)):
        y[k] -= lu[k, :k] @ y[:k]
    for k in range(len(y) - 1, -1, -1):
        y[k] = (y[k] - (lu[k, k + 1:] @ y[k + 1:] if k + 1 < len(y) else 0)) / lu[k, k]
    return y


def null_space(m: list[list[int]], root: decimal.Decimal, within: int, rounds: int = 3) -> np.ndarray:
    """``within`` orthonormal vectors (rows) that span the eigenvectors of
    ``root``, by inverse iteration in the present decimal context."""
    n = len(m)
    a = np.array([[decimal.Decimal(v) for v in row] for row in m], object)
    a[np.arange(n), np.arange(n)] -= root
    lu, swaps = _factor(a)
    rng = np.random.default_rng([1, n, within])
    basis = [np.array([decimal.Decimal(int(v)) for v in rng.integers(-1000, 1001, n)], object) for _ in range(within)]
    for _ in range(rounds):
        done: list[np.ndarray] = []
        for v in basis:
            v = _solve(lu, swaps, v)
            v = v / max(abs(e) for e in v)
            for _ in range(2):
                for u in done:
                    v = v - (u @ v) * u
            done.append(v / (v @ v).sqrt())
        basis = done
    out = np.array([[float(e) for e in v] for v in basis])
    # one sign for all: the entry of the largest size is positive
    lead = out[np.arange(len(out)), np.abs(out).argmax(axis=1)]
    return out * np.sign(lead)[:, None]


def component(m: list[list[int]], poly: list[int], nth: int) -> tuple[float, list[float]] | None:
    """Eigenvalue and unit eigenvector of the ``nth`` largest root; None for
    a root 0."""
    top = sum(m[i][i] for i in range(len(m)))
    low, above, within = nth_root(poly, nth, top, FRACTION)
    if low < 0:
        return None
    digits = int((FRACTION + top.bit_length()) * math.log10(2)) + 1
    with decimal.localcontext(prec=2 * digits + DIGITS, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN):
        root = decimal.Decimal(2 * low + 1) / decimal.Decimal(1 << FRACTION + 1)
        return float(root), null_space(m, root, within)[nth - above - 1].tolist()


@dataclass(frozen=True)
class Whitener:
    """``components`` rows: eigenvalue of the covariance and unit vector."""
    n: int
    sums: tuple[int, ...]
    components: tuple[tuple[float, tuple[float, ...]], ...]
    trace: float


def _components(m: list[list[int]], poly: list[int]):
    def run(batches):
        for batch in batches:
            nth = batch.column("nth").to_pylist()
            got = [component(m, poly, i) for i in nth]
            keep = [i for i, g in enumerate(got) if g]
            yield pa.RecordBatch.from_arrays(
                [pa.array([nth[i] for i in keep], pa.int32()), pa.array([got[i][0] for i in keep], pa.float64()),
                 pa.array([got[i][1] for i in keep], pa.list_(pa.float64()))], ["nth", "root", "vec"])
    return run


def whitener(spark: SparkSession, n: int, sums: list[int], gram: list[list[int]], count: int) -> Whitener:
    """The first ``count`` components of the vectors with these moments."""
    dim = len(sums)
    m = [[n * gram[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    unit = math.gcd(*(v for row in m for v in row)) if dim else 0
    if not unit:
        return Whitener(n, tuple(sums), (), 0.0)
    small = [[v // unit for v in row] for row in m]
    poly = characteristic_polynomial(spark, small)
    rows = spark.createDataFrame([(i,) for i in range(1, min(count, dim) + 1)], "nth int").repartition(min(count, dim))
    found = rows.mapInArrow(_components(small, poly), "nth int, root double, vec array<double>").collect()
    scale = unit / (n * n)
    return Whitener(n, tuple(sums), tuple((r["root"] * scale, tuple(r["vec"])) for r in sorted(found, key=lambda r: r["nth"])),
                    sum(m[i][i] for i in range(dim)) / (n * n))


def whiten_rows(x: np.ndarray, w: Whitener) -> tuple[list[int], np.ndarray]:
    """Exact squared deviation from the mean (times n * n) and the whitened
    components of integer rows."""
    top = w.n * int(np.abs(x).max(initial=0)) + max(map(abs, w.sums), default=0)
    exact = top * top * max(1, x.shape[1]) >= 1 << 63
    away = w.n * (x.astype(object) if exact else x) - np.array(w.sums, object if exact else np.int64)
    deviation = (away * away).sum(axis=1)
    vecs = np.array([v for _, v in w.components]).reshape(len(w.components), x.shape[1])
    sizes = np.array([w.n * math.sqrt(e) for e, _ in w.components])
    return deviation.tolist(), away.astype(np.float64) @ vecs.T / sizes


def _projected(models: dict[int, Whitener], carry: list[str]):
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for s in range(0, batch.num_rows, PIECE):
                part, d = pa.Table.from_batches([batch.slice(s, PIECE)]), dims[s:s + PIECE]
                for dim in np.unique(d):
                    rows = part.filter(pa.array(d == dim))
                    deviation, y = whiten_rows(matrix(rows, "x"), models[int(dim)])
                    yield pa.RecordBatch.from_arrays(
                        [*(rows.column(c).combine_chunks() for c in carry), rows.column("dim").combine_chunks(),
                         pa.array([decimal.Decimal(v) for v in deviation], pa.decimal128(38, 0)),
                         pa.array(list(y), pa.list_(pa.float64()))], [*carry, "dim", "deviation", "whitened"])
    return run


def _identity_error(fit: DataFrame, models: dict[int, Whitener]) -> dict[int, float]:
    """By vector length: the largest entry of the whitened fit list's
    covariance minus the identity."""
    y = fit.select("dim", "x").mapInArrow(_projected(models, []), "dim int, deviation decimal(38,0), whitened array<double>")
    most = max((len(w.components) for w in models.values()), default=0)
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    if not pairs:
        return {}
    at = [F.get("whitened", F.lit(i)) for i in range(most)]
    got = y.groupBy("dim").agg(*[F.covar_pop(at[i], at[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()
    return {r["dim"]: max((abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if r[f"c{i}_{j}"] is not None), default=0.0) for r in got}


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """``<id>, component, n, deviation, whitened, explained, identity_error``
    for every usable row and each of the first ``components`` components, by
    falling eigenvalue.  A vector's components times ``scale`` are rounded
    down; the mean and the covariance (divisor ``n``) are those of the ``n``
    different results.  ``deviation`` is the exact sum of ``(n x - S)^2``.

    Defined cases: rows whose vector is null, or holds a null or non-finite
    component, are left out; equal vectors count once in the fit and each row
    gets its result; every vector length is fitted on its own; components of
    eigenvalue 0 are left out (one vector, equal vectors, empty vectors: no
    rows); equal eigenvalues get an orthonormal basis; rows with a null id
    keep it; an empty table gives an empty result; other columns are not
    read.  Sums of products of over 38 digits are an error.  The driver holds
    ``dim * dim`` moments and the polynomial of a length, no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(whole_vector(F.col(vec_col))).select(F.col(id_col).alias("key"), scaled(F.col(vec_col), scale).alias("x"))
    rows = cut_lineage(rows.withColumn("dim", F.size("x")).where(F.col("dim") > 0))
    fit = cut_lineage(rows.select("dim", "x").distinct())
    models = {dim: whitener(spark, *m, components) for dim, m in sorted(moments(fit).items())}
    error = _identity_error(fit, models)
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(_projected(models, ["key"]), f"key {kind}, dim int, deviation decimal(38,0), whitened array<double>")

    def by_dim(value, kind: str) -> Column:
        col = F.lit(None).cast(kind)
        for dim, w in models.items():
            col = F.when(F.col("dim") == dim, F.lit(value(dim, w)).cast(kind)).otherwise(col)
        return col
    shares = F.lit(None).cast("array<double>")
    for dim, w in models.items():
        shares = F.when(F.col("dim") == dim, F.array(*[F.lit(e / w.trace) for e, _ in w.components]).cast("array<double>")).otherwise(shares)
    out = out.select("key", "deviation", "dim", shares.alias("shares"), F.posexplode("whitened").alias("pos", "whitened"))
    return out.select(F.col("key").alias(id_col), (F.col("pos") + 1).cast("int").alias("component"),
                      by_dim(lambda d, w: w.n, "bigint").alias("n"), "deviation", "whitened",
                      F.get("shares", F.col("pos")).alias("explained"),
                      by_dim(lambda d, w: error.get(d, 0.0), "double").alias("identity_error"))
