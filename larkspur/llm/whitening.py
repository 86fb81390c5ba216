"""Operator 12: embedding whitening, its components found by spectrum slicing.

Components are scaled to whole numbers, x = floor(scale * c), so that sums and deviations are exact. The
covariance is over the distinct x-vectors, centred before it is multiplied; tasks add up the products of
their vectors and Spark adds up the tasks, so that only one matrix of the vectors' length comes back.

Its leading eigenvalues are isolated by counting. An LDL^T factorisation of the covariance less a shift
has as many positive pivots as there are eigenvalues above the shift (Sylvester's law of inertia), so
halving an interval by counts leaves one eigenvalue in it. From there Rayleigh quotient iteration
converges cubically; a quotient that leaves the interval sends it back to the halving. At the end, counts
just below and just above each value certify its number.

Results in odd cases: rows whose vector is null, empty, or holds null or non-finite components are dropped;
vectors of each length are whitened by themselves; equal vectors count once in the fit and rows of
one id are rows of their own; components without variance (all vectors equal, or fewer than components
asked for) have no rows; x that does not fit a long stays at its limit, and a deviation that does not
fit is null; equal eigenvalues share their space, in which any basis may come; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, table

#: Rows of a batch that are multiplied at once.
BLOCK = 2048
#: An eigenvalue below this share of the trace counts as none.
NOISE = 1e-13


def pivots(a: np.ndarray) -> list[np.ndarray]:
    """The diagonal blocks of D in P A P^T = L D L^T, of one row or two (Bunch and Kaufman's choice of pivots)."""
    a, out, k, n = a.copy(), [], 0, len(a)
    alpha = (1 + np.sqrt(17)) / 8
    while k < n:
        size, swap = 1, k
        if k + 1 < n:
            r = k + 1 + int(np.abs(a[k + 1 :, k]).argmax())
            below = abs(a[r, k])
            if abs(a[k, k]) < alpha * below:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                widest = row.max()
                if abs(a[k, k]) * widest < alpha * below**2:
                    size, swap = (1, r) if abs(a[r, r]) >= alpha * widest else (2, r)
        at = k + size - 1
        if swap != at:
            a[[at, swap], k:] = a[[swap, at], k:]
            a[k:, [at, swap]] = a[k:, [swap, at]]
        d = a[k : k + size, k : k + size].copy()
        out.append(d)
        below_ = a[k + size :, k : k + size]
        if size == 1:
            if d[0, 0] != 0:
                a[k + 1 :, k + 1 :] -= np.outer(below_[:, 0] / d[0, 0], below_[:, 0])
        else:
            a[k + 2 :, k + 2 :] -= below_ @ np.linalg.solve(d, below_.T)
        k += size
    return out


def above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above a shift, by the signs of the pivots of a - shift."""
    count = 0
    for d in pivots(a - shift * np.eye(len(a))):
        if len(d) == 1:
            count += bool(d[0, 0] > 0)
        else:
            # a block of two has a negative determinant: one eigenvalue of each sign; else the sign of its trace
            count += 1 if d[0, 0] * d[1, 1] < d[0, 1] * d[1, 0] else 2 * bool(d[0, 0] + d[1, 1] > 0)
    return count


def turned(a: np.ndarray, shift: float, x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """One step of inverse iteration, kept apart from the vectors found before."""
    n, eye = len(a), np.eye(len(a))
    for k in range(4):
        try:
            y = np.linalg.solve(a - (shift + k * 4 * np.finfo(float).eps * max(1, abs(shift))) * eye, x)
        except np.linalg.LinAlgError:
            continue  # the shift is an eigenvalue to the last bit
        if np.isfinite(y).all() and np.abs(y).max() > 0:
            y /= np.abs(y).max()
            for _ in range(2):
                y = y - found.T @ (found @ y)
            if (size := np.sqrt(y @ y)) > 1e-12 * n:
                return y / size
    return x


def leading(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues, falling, with unit eigenvectors as rows, as many as have variance.

    Every value's number is certified: at most k - 1 eigenvalues lie above it and at least k above what lies just below it.
    """
    n, trace = len(cov), float(np.trace(cov))
    if n == 0 or not trace > 0:
        return np.zeros(0), np.zeros((0, n))
    a = (cov + cov.T) / (2 * trace)  # eigenvalues from 0 to 1
    eps = np.finfo(float).eps
    values, vectors = [], np.zeros((0, n))
    start = np.random.default_rng(12).normal(size=n)
    for k in range(1, min(most, n) + 1):
        low, high, at_high = NOISE, 1.0 + 1e-9, 0
        at_low = above(a, low)
        if at_low < k:
            break
        x = rho = None
        while x is None:
            # halve until the k-th stands alone, or with values that a double does not tell apart
            while at_low - at_high > 1 and high - low > 8 * eps * high:
                mid = (low + high) / 2
                count = above(a, mid)
                low, at_low, high, at_high = (mid, count, high, at_high) if count >= k else (low, at_low, mid, count)
            x, rho = start - vectors.T @ (vectors @ start), (low + high) / 2
            x /= np.sqrt(x @ x)
            for _ in range(3):
                x = turned(a, rho, x, vectors)
            for _ in range(30):
                rho = float(x @ a @ x)
                if not low - 8 * eps <= rho <= high + 8 * eps:
                    break
                rest = a @ x - rho * x
                if np.sqrt(rest @ rest) <= 4 * eps * n**0.5:
                    break
                x = turned(a, rho, x, vectors)
            rho = float(x @ a @ x)
            error = np.sqrt(((a @ x - rho * x) ** 2).sum()) + 16 * eps * n**0.5
            sound = low - error <= rho <= high + error and error < 1e-9 and above(a, rho + error) < k <= above(a, rho - error)
            if not sound and high - low > 8 * eps * high:
                mid = (low + high) / 2
                count = above(a, mid)
                low, at_low, high, at_high = (mid, count, high, at_high) if count >= k else (low, at_low, mid, count)
                x = None
            elif not sound:
                raise ArithmeticError(f"eigenvalue {k} could not be certified")
        values.append(rho * trace)
        vectors = np.vstack([vectors, x * np.sign(x[np.abs(x).argmax()])])
    return np.array(values), vectors


def scaled(vectors: DataFrame, key: str, scale: float) -> DataFrame:
    """(key, x) of the rows whose components are all finite; x are longs."""
    v = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    sound = (F.size("embedding") > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    limit = float(2**62)
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(key).alias("_key"), F.transform(v, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(limit)), F.lit(-limit)))).alias("x"))


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """(rows, length) of a batch whose lists are equally long."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(length, rows) of blocks of rows whose vectors are equally long."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            rows = batch.filter(pa.array(dims == dim))
            for at in range(0, rows.num_rows, BLOCK):
                yield dim, rows.slice(at, BLOCK)


def totals(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Length -> (vectors, sums of their components), exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows in alike(batches):
            x = matrix(rows)
            cols = [np.full(dim, dim), np.arange(dim), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), np.full(dim, len(x))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["dim", "at", "high", "low", "n"])

    parts = fit.mapInArrow(run, "dim bigint, at bigint, high bigint, low bigint, n bigint")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out: dict[int, tuple[int, list[int]]] = {}
    # one row for each component of a length
    for r in parts.groupBy("dim", "at").agg(wide("high"), wide("low"), F.sum("n").alias("n")).orderBy("dim", "at").collect():
        out.setdefault(r.dim, (r.n, []))[1].append((int(r.high) << 32) + int(r.low))
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, in 64 bits where they hold it, else in Python's integers."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if most < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def squares(d: np.ndarray) -> list[int | None]:
    """Sum of squares of each row; None where a long does not hold it."""
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    sums = (sum(v * v for v in map(int, row)) for row in d)
    return [s if s < 1 << 63 else None for s in sums]


def products(fit: DataFrame, centred) -> dict[int, np.ndarray]:
    """Length -> sum over the fit list of y y^T, y being what `centred` makes of a block of x-vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for dim, rows in alike(batches):
            y = centred(dim, matrix(rows))
            sums[dim] = sums.get(dim, 0) + y.T @ y
        for dim, s in sums.items():
            i, j = np.triu_indices(len(s))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim)), pa.array(i), pa.array(j), pa.array(s[i, j])], ["dim", "i", "j", "value"])

    parts = fit.mapInArrow(run, "dim bigint, i bigint, j bigint, value double").groupBy("dim", "i", "j").agg(F.sum("value").alias("value"))
    found: dict[int, list] = {}
    # one row for each pair of components of a length
    for r in parts.toLocalIterator():
        found.setdefault(r.dim, []).append((r.i, r.j, r.value))
    out = {}
    for dim, cells in found.items():
        i, j, value = (np.array(c) for c in zip(*cells, strict=True))
        s = np.zeros((i.max() + 1, i.max() + 1))
        s[i, j] = s[j, i] = value
        out[dim] = s
    return out


def whitened(vectors: DataFrame, components: int = 4, scale: float = 256.0, key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each sound row and component."""
    rows = scaled(vectors, key, scale)
    fit = table(rows.groupBy("x").count().select("x", F.size("x").cast("long").alias("dim")), "whitening-fit")
    sums = totals(fit)

    def centred(dim: int, x: np.ndarray) -> np.ndarray:
        n, s = sums[dim]
        return deviations(x, n, s).astype(np.float64) / n

    covariances = products(fit, centred)
    space: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim, s in covariances.items():
        values, axes = leading(s / sums[dim][0], components)
        space[dim] = (values / np.trace(s / sums[dim][0]) if len(values) else values, axes / np.sqrt(values)[:, None])

    def projected(dim: int, x: np.ndarray) -> np.ndarray:
        return centred(dim, x) @ space[dim][1].T

    # measured on the vectors, not taken from the solver
    errors = {dim: float(np.abs(s / sums[dim][0] - np.eye(len(s))).max(initial=0)) for dim, s in products(fit.where(F.col("dim").isin([d for d in space if len(space[d][0])])), projected).items()}
    kind = rows.schema["_key"].dataType
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in alike(batches):
            share = space[dim][0]
            k = len(share)
            if not k:
                continue
            x = matrix(part)
            n, s = sums[dim]
            d = deviations(x, n, s)
            w = (d.astype(np.float64) / n) @ space[dim][1].T
            each = np.repeat(np.arange(len(x)), k)
            cols = [part.column("_key").take(pa.array(each)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(each), n), pa.array(squares(d), pa.int64()).take(pa.array(each)), w.ravel(), np.tile(share, len(x)), np.full(len(each), errors[dim])]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)

    fields = ", ".join(["`" + key.replace("`", "``") + "` " + kind.simpleString(), "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"])
    return rows.select("_key", "x", F.size("x").cast("long").alias("dim")).mapInArrow(run, fields)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: whitened components of every vector."""
    return whitened(documents(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
