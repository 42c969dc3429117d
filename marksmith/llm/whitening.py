"""Whitening of embeddings by exact integer arithmetic.

A vector's entries c become integers x = floor(64 c) + 1000000, and the fit list holds each distinct integer
vector once. Its scatter M = n * sum(x x') - S S' (n vectors, sums S) is an integer matrix, n * n times the
covariance, and nothing about it is rounded. The characteristic polynomial of M comes from its residues: for
each of as many primes as its largest coefficient needs, the matrix is brought to Hessenberg form modulo the prime, from
which the polynomial is read off; the Chinese remainder theorem puts the integers together, and one more prime
checks them. All roots of the polynomial are real, so Descartes' rule of signs counts the roots above a point
exactly; bisection by that count isolates the largest roots, multiple ones included, to 2**-ROOT_BITS.
Components are vectors of the null space of M minus a root, found by inverse iteration in fixed-point
integers, so that they are right to double precision even where roots lie close together.

Spark does what grows with the data (distinct vectors, partial scatters, projections) and deals out primes and
components as tasks. The driver sees the scatter and as many residues as primes, whose size depends on the dimension alone.

Defined results: rows whose vector is null or empty, or holds null, NaN, infinite entries, or entries of 1e17 and more
(no long holds 64 times that), are left out, and so are vectors of another length than the most common one (of
equally common ones the shortest). Equal vectors, repeated rows and null ids give a row of their own each. Components
without variance don't exist: there are as many as the scatter's rank, ``limit`` at most, so that a fit list of one vector, or
an empty table, gives an empty result. A deviation that no long holds is null. Only the id and the vector are read, so extra
columns may have any names and types. A row's size is that of its vector; there are no texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SCALE, OFFSET, COMPONENTS, LARGEST_ENTRY = 64, 1_000_000, 16, 1e17
#: Fractional bits of the roots, and of the numbers of the inverse iteration.
ROOT_BITS, SOLVE_BITS, ITERATIONS = 96, 384, 3
#: Limbs whose products, summed over EXACT_ROWS rows, a double holds exactly.
LIMB, EXACT_ROWS = 20, 1 << 13
SPLIT = 10**18


def integer_vectors(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, y array<long>): y = floor(64 c), which is x without the offset, of the rows that can be used."""
    v = embeddings[vec_col].cast("array<double>")
    usable = F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c) < LARGEST_ENTRY, F.lit(False))), F.lit(False))
    return embeddings.where(usable).select(embeddings[id_col].alias("vec_id"), F.transform(v, lambda c: F.floor(c * SCALE).cast("long")).alias("y"))


def of_common_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows with the most common length, and that length (0 without rows)."""
    best = rows.groupBy(F.size("y").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    d = best["d"] if best else 0
    return rows.where(F.size("y") == d), d


def matrix_of(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y' y in whole numbers: matrix products of limbs, each exact in doubles."""
    d = y.shape[1]
    total = np.zeros((d, d), dtype=object)
    for at in range(0, len(y), EXACT_ROWS):
        rest, limbs = y[at : at + EXACT_ROWS], []
        while rest.min() < -(1 << LIMB) or rest.max() >= 1 << LIMB:
            limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
            rest = rest >> LIMB
        limbs.append(rest.astype(np.float64))
        for a, left in enumerate(limbs):
            for b, right in enumerate(limbs):
                total += (left.T @ right).astype(np.int64).astype(object) * (1 << LIMB * (a + b))
    return total


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of y, and n * sum(y y') - sums sums', all exact."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, sums, n = np.zeros((d, d), dtype=object), np.zeros(d, dtype=object), 0
        for batch in batches:
            y = matrix_of(batch.column("y"), d)
            if len(y):
                gram, sums, n = gram + exact_gram(y), sums + y.astype(object).sum(axis=0), n + len(y)
        if n:
            i, j = np.triu_indices(d)
            rows = [*zip(i.tolist(), j.tolist(), gram[i, j]), *((k, -1, s) for k, s in enumerate(sums)), (-1, -1, n)]
            names, low = ("i", "j", "high", "low"), [v % SPLIT for _, _, v in rows]
            high = [(v - w) // SPLIT for (_, _, v), w in zip(rows, low)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(([r[0] for r in rows], [r[1] for r in rows], high, low), kinds)], names=names)

    parts = fit.select("y").mapInArrow(partial, "i int, j int, high long, low long")
    added = parts.groupBy("i", "j").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    found = {(r["i"], r["j"]): int(r["high"]) * SPLIT + int(r["low"]) for r in added.collect()}  # (d + 1) (d + 2) / 2 rows
    n, sums = found.get((-1, -1), 0), [found.get((k, -1), 0) for k in range(d)]
    pair = lambda a, b: found.get((min(a, b), max(a, b)), 0)
    return n, sums, [[n * pair(a, b) - sums[a] * sums[b] for b in range(d)] for a in range(d)]


def is_prime(p: int) -> bool:
    """Exact below 3,215,031,751 (Miller and Rabin with the bases 2, 3, 5 and 7)."""
    if p < 11 or p % 2 == 0:
        return p in (2, 3, 5, 7)
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if x in (1, p - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % p
            if x == p - 1:
                break
        else:
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """Primes from 2**31 downwards whose product is over 2 * bound, and one more."""
    found, product, p = [], 1, (1 << 31) - 1
    while product <= 2 * bound:
        if is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    while not is_prime(p):
        p -= 2
    return [*found, p]


def hessenberg(matrix: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``matrix`` modulo p with zeros below the first subdiagonal."""
    h = matrix % p
    for m in range(1, len(h) - 1):
        nonzero = np.flatnonzero(h[m:, m - 1])
        if not len(nonzero):
            continue
        pivot = m + int(nonzero[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor % p).sum(axis=1)) % p
    return h


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients, lowest first, of det(t - matrix) modulo p."""
    h = hessenberg(matrix, p)
    d = len(h)
    made = np.zeros((d + 1, d + 1), dtype=np.int64)  # row k: the polynomial of the leading k x k block
    made[0, 0] = 1
    for k in range(1, d + 1):
        made[k, 1:] = made[k - 1, :-1]
        made[k] = (made[k] - h[k - 1, k - 1] * made[k - 1]) % p
        below = 1
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            made[k] = (made[k] - (int(h[i - 1, k - 1]) * below % p) * made[i - 1]) % p
    return made[d].tolist()


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Coefficients, lowest first, of det(t - m) for a positive semidefinite integer matrix: residues by Spark tasks, put together here."""
    d, trace = len(m), sum(m[k][k] for k in range(len(m)))
    bound = max(comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))  # of products of k eigenvalues, by their mean
    primes = primes_for(bound)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = batch.column("p").to_pylist()
            found = [polynomial_mod(np.array([[v % p for v in row] for row in m], dtype=np.int64), p) for p in ps]
            yield pa.RecordBatch.from_arrays([pa.array(ps, type=pa.int64()), pa.array(found, type=pa.list_(pa.int64()))], names=["p", "c"])

    tasks = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 2 * spark.sparkContext.defaultParallelism))
    rest = {r["p"]: r["c"] for r in tasks.mapInArrow(residues, "p long, c array<long>").collect()}
    value, modulus = [0] * (d + 1), 1
    for p in primes[:-1]:
        inverse = pow(modulus, -1, p)
        value = [v + modulus * ((c - v) * inverse % p) for v, c in zip(value, rest[p])]
        modulus *= p
    value = [v - modulus if 2 * v > modulus else v for v in value]
    if any((v - c) % primes[-1] for v, c in zip(value, rest[primes[-1]])):
        raise ArithmeticError("the residues don't belong to one polynomial")
    return value


def roots_above(poly: list[int], point: int) -> int:
    """How many roots, each as often as it occurs, are larger; exact for polynomials whose roots are all real."""
    c = list(poly)
    for k in range(len(c) - 1):
        for i in range(len(c) - 2, k - 1, -1):
            c[i] += point * c[i + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(poly: list[int], limit: int, bits: int = ROOT_BITS) -> list[tuple[int, int]]:
    """(root times 2**bits, how often it occurs) of the positive roots of a real-rooted integer polynomial without negative ones, falling, up to ``limit`` of them.

    Roots closer than 2**-bits count as one that occurs several times. A root's number is the end of an interval of that width above it.
    """
    zeros = next(k for k, v in enumerate(poly) if v)
    poly = poly[zeros:]
    degree = len(poly) - 1
    scaled = [v << bits * (degree - k) for k, v in enumerate(poly)]  # its roots are 2**bits times as large
    top = -scaled[-2] if degree else 0  # their sum

    def refined(lo: int, hi: int, above: int) -> int:
        """The end of the unit interval in (lo, hi] with the only root there; ``above`` roots are larger than hi."""
        while hi - lo > 1:
            mid, value = (lo + hi) // 2, 0
            for v in reversed(scaled):
                value = value * mid + v
            if value == 0:
                return mid
            inside = (value < 0) == (above % 2 == 0)  # the sign changes with every root above
            lo, hi = (mid, hi) if inside else (lo, mid)
        return hi

    found: list[tuple[int, int]] = []
    open_parts = [(0, top, degree, 0)]
    while open_parts and sum(k for _, k in found) < limit:
        lo, hi, above_lo, above_hi = open_parts.pop()
        if above_lo == above_hi:
            continue
        if above_lo - above_hi == 1:
            found.append((refined(lo, hi, above_hi), 1))
        elif hi - lo <= 1:
            found.append((hi, above_lo - above_hi))
        else:
            mid = (lo + hi) // 2
            above = roots_above(scaled, mid)
            open_parts += [(lo, mid, above_lo, above), (mid, hi, above, above_hi)]  # the upper part is looked at first
    return found


def null_vectors(m: list[list[int]], root: int, count: int, bits: int = ROOT_BITS, precision: int = SOLVE_BITS) -> list[list[float]]:
    """``count`` orthonormal vectors that m - root / 2**bits takes to zero, by inverse iteration in fixed point."""
    d, one = len(m), 1 << precision
    a = np.array([[(v << bits) - (root if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(m)], dtype=object)
    size = max(1, max(abs(v) for v in a.ravel()).bit_length())
    a = np.array([[v * one >> size for v in row] for row in a], dtype=object)
    order, factors = list(range(d)), []
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
            for f in factors:
                f[k], f[pivot] = f[pivot], f[k]
        if a[k, k] == 0:
            a[k, k] = 1  # the smallest step of the fixed point
        factor = np.array([0] * (k + 1) + [(v << precision) // a[k, k] for v in a[k + 1 :, k]], dtype=object)
        if k + 1 < d:
            a[k + 1 :, k:] -= factor[k + 1 :, None] * a[k, k:] >> precision
        factors.append(factor)

    def solved(b: list[int]) -> list[int]:
        y = np.array([b[i] for i in order], dtype=object)
        for k in range(d):
            y[k + 1 :] -= factors[k][k + 1 :] * y[k] >> precision
        for k in range(d - 1, -1, -1):
            y[k] = (y[k] << precision) // a[k, k]
            y[:k] -= a[:k, k] * y[k] >> precision
        return y.tolist()

    def unit(v: list[int], others: list[list[int]]) -> list[int]:
        for _ in range(2):
            for o in others:
                along = sum(x * y for x, y in zip(v, o)) >> precision
                v = [x - (along * y >> precision) for x, y in zip(v, o)]
        shift = max(0, precision - max(abs(x) for x in v).bit_length())
        v = [x << shift for x in v]
        length = isqrt(sum(x * x for x in v))
        return [(x << precision) // length for x in v]

    made: list[list[int]] = []
    for k in range(count):
        v = [one // (1 + (i * (2 * k + 3) + k) % d) * (-1 if i * (k + 1) % 3 == 1 else 1) for i in range(d)]
        for _ in range(ITERATIONS):
            v = unit(solved(unit(v, made)), made)
        made.append(v)
    return [[x / one for x in v] for v in made]


def components(spark: SparkSession, m: list[list[int]], limit: int = COMPONENTS) -> list[tuple[float, list[float]]]:
    """(eigenvalue of m, unit vector), by falling eigenvalue, of up to ``limit`` positive ones; each root's vectors are a task."""
    roots = largest_roots(characteristic_polynomial(spark, m), limit)
    if not roots:
        return []

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, root, count in zip(*[batch.column(c).to_pylist() for c in ("place", "root", "count")]):
                yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([null_vectors(m, int(root), count)], type=pa.list_(pa.list_(pa.float64())))], names=["place", "v"])

    rows = [(k, str(root), count) for k, (root, count) in enumerate(roots)]
    tasks = spark.createDataFrame(rows, "place long, root string, count int").repartition(len(rows))
    vectors = {r["place"]: r["v"] for r in tasks.mapInArrow(solve, "place long, v array<array<double>>").collect()}
    return [(root / (1 << ROOT_BITS), list(v)) for k, (root, _) in enumerate(roots) for v in vectors[k]][:limit]


def centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * y - sums in whole numbers, as longs where they fit."""
    largest = max(abs(int(y.min())), abs(int(y.max()))) if y.size else 0
    if n * largest + max(map(abs, sums)) < 1 << 62:
        return n * y - np.array(sums, dtype=np.int64)
    return n * y.astype(object) - np.array(sums, dtype=object)


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", limit: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row and component."""
    spark = embeddings.sparkSession
    rows, d = of_common_length(integer_vectors(embeddings, id_col, vec_col))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = written(rows.select("y").distinct(), "fit")
    n, sums, m = scatter(fit, d) if d else (0, [], [])
    found = components(spark, m, limit) if n > 1 else []
    if not found:
        return spark.createDataFrame([], schema)
    trace = sum(m[k][k] for k in range(d))
    vectors = np.array([v for _, v in found]).T
    lengths = np.sqrt([e for e, _ in found])
    explained = np.array([e / trace for e, _ in found])
    k = len(found)

    def projected(moved: np.ndarray) -> np.ndarray:
        return moved.astype(np.float64) @ vectors / lengths

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = projected(centred(matrix_of(batch.column("y"), d), n, sums))
                total += w.T @ w
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, type=pa.int32()), pa.array(j, type=pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    # the mean of whitened vectors is zero, since they are made of centred integers
    covariance = fit.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # k * k rows
    error = max(abs(r["v"] / n - (r["i"] == r["j"])) for r in covariance)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            moved = centred(matrix_of(batch.column("y"), d), n, sums)
            largest = max(abs(int(moved.min())), abs(int(moved.max())))
            exact = moved if largest * largest * d < 1 << 63 else moved.astype(object)
            deviation = [v if v < 1 << 63 else None for v in (exact * exact).sum(axis=1).tolist()]
            ids, w = batch.column("vec_id"), projected(moved)
            of = np.repeat(np.arange(len(w)), k)
            columns = [
                ids.take(pa.array(of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))), pa.array(np.full(len(of), n, dtype=np.int64)),
                pa.array(deviation, type=pa.int64()).take(pa.array(of)), pa.array(w.ravel()), pa.array(np.tile(explained, len(w))), pa.array(np.full(len(of), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "y").mapInArrow(out, schema)
