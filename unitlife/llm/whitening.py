"""Operator 11: embedding whitening by FEAST contour integration.

One pass sums every dimension, a second one the products of the centred integers; both sums are exact whatever the
row order. The covariance that follows from them is a matrix of the vector's width, so its size does not depend on the
rows. Inertia counts (signs of the pivots of the shifted matrix in tridiagonal form) cut the part of the spectrum that
holds the wanted components into intervals of a few eigenvalues each. Every interval is a row of a Spark job: a task
integrates the resolvent around its interval (complex shifted solves at Gauss-Legendre nodes) to project a block of
vectors onto the interval's eigenspace, extracts pairs by Rayleigh-Ritz, repeats until the residuals vanish, and stops
only when it holds as many pairs as the interval's inertia count says. A last pass projects the rows.

A vector that is null, or holds a null, a non-finite component or one whose integer needs more than 62 bits, takes no
part. All vectors of a fit have one width, the most frequent (of equally frequent ones the greatest); others take no
part. Repeated rows count as often as they come; an id may be null or repeated. A component whose eigenvalue is zero
(below 1e-12 of the trace) is not returned, so fewer than asked come where the vectors span fewer dimensions, and none
where all are equal; an empty table gives an empty result. Equal eigenvalues get some orthonormal basis of their
space, the same for all rows. ``deviation`` is null where it does not fit in a long; ``deviation_exact`` has it as a
decimal. Other columns are not read. The driver holds matrices of width x width.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitlife.llm.shared import stored

LIMB = 20  # bits; products of two limbs sum exactly in doubles over 2^13 rows
LIMB_ROWS = 1 << 13
CELLS = 1 << 21  # of a matrix that a task holds
UNIT = 10 ** 18  # exact totals travel as (quotient, rest)
NODES = 8
PER_INTERVAL = 4
ZERO = 1e-12  # of the trace
ROUNDS = 12

TOTALS = "width int, i int, j int, quotient decimal(38,0), rest decimal(38,0)"


def integers(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024,
             offset: int = 100_000) -> DataFrame:
    """``(vec_id, x)``: the usable vectors, as ``floor(scale * c) + offset``."""
    fits = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) * scale < F.lit(float(1 << 62))))
    return df.filter(F.col(vector).isNotNull() & fits).select(
        F.col(vec_id).alias("vec_id"),
        F.transform(vector, lambda c: F.floor(scale * c.cast("double")).cast("bigint") + offset).alias("x"))


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows of the vectors of each width, a bounded number of cells at a time."""
    lists = batch.column(column)
    widths = lists.value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        step = max(CELLS // max(int(width), 1), 1)
        for start in range(0, len(at), step):
            own = at[start:start + step]
            cells = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False)
            yield own, cells.reshape(len(own), int(width))


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def _total(x: np.ndarray) -> np.ndarray:
    """Exact column sums, as Python integers."""
    wide = _largest(x) * max(len(x), 1) >= 1 << 62
    return (x.astype(object) if wide else x).sum(0).astype(object)


def gram(y: np.ndarray) -> np.ndarray:
    """Exact ``y.T @ y`` of integers, as Python integers: products of limbs are summed in doubles."""
    width, limbs = y.shape[1], max(-(-_largest(y).bit_length() // LIMB), 1)
    out = np.zeros((width, width), object)
    for start in range(0, len(y), LIMB_ROWS):
        rest, parts = y[start:start + LIMB_ROWS], []
        for _ in range(limbs - 1):
            parts.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
            rest = rest >> LIMB
        parts.append(rest.astype(np.float64))
        for a, left in enumerate(parts):
            for b, right in enumerate(parts):
                out += (left.T @ right).astype(np.int64).astype(object) << (LIMB * (a + b))
    return out


def _totals(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    exact = pa.decimal128(38, 0)
    split = [divmod(int(r[3]), UNIT) for r in rows]
    return pa.record_batch([
        *(pa.array([r[k] for r in rows], pa.int32()) for k in range(3)),
        *(pa.array([decimal.Decimal(s[k]) for s in split], exact) for k in range(2))],
        ["width", "i", "j", "quotient", "rest"])


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy("width", "i", "j").agg(F.sum("quotient").alias("quotient"), F.sum("rest").alias("rest"))


class Moments(NamedTuple):
    n: int
    sums: list[int]
    covariance: np.ndarray | None


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors of the most frequent width, and the exact sum of each dimension."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        out = lambda: _totals([(w, i, 0, t) for w, (n, s) in held.items() for i, t in enumerate([*s, n])])
        for batch in batches:
            for at, x in _matrices(batch, "x"):
                n, s = held.get(x.shape[1], (0, 0))
                held[x.shape[1]] = n + len(at), s + _total(x)
                if sum(held) > CELLS:
                    yield out()
                    held.clear()
        yield out()

    # the entry after the last dimension's is the number of rows
    order = F.sort_array(F.collect_list(F.struct("i", "quotient", "rest"))).alias("entries")
    widths = _summed(vectors.select("x").mapInArrow(add, TOTALS)).groupBy("width").agg(
        order, F.max_by(F.col("quotient") * F.lit(UNIT).cast("decimal(38,0)") + F.col("rest"), "i").alias("n"))
    best = widths.orderBy(F.desc("n"), F.desc("width")).first()
    if best is None:
        return 0, []
    totals = [int(e["quotient"]) * UNIT + int(e["rest"]) for e in best["entries"]]
    return totals[-1], totals[:-1]


def moments(vectors: DataFrame) -> Moments:
    """Count, sums and covariance (divisor ``n``), the last rounded once from exact integers."""
    n, total = sums(vectors)
    width = len(total)
    if not n or not width:
        return Moments(n, total, None)
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((width, width), object)
        for batch in batches:
            for _, x in _matrices(batch, "x"):
                held += gram(x - centre)
        yield _totals([(width, i, j, held[i, j]) for i in range(width) for j in range(i, width)])

    rows = _summed(vectors.filter(F.size("x") == width).select("x").mapInArrow(add, TOTALS)).toLocalIterator()
    off = [s - n * int(c) for s, c in zip(total, centre, strict=True)]
    covariance = np.empty((width, width))
    for r in rows:
        products = int(r["quotient"]) * UNIT + int(r["rest"])
        value = (n * products - off[r["i"]] * off[r["j"]]) / (n * n)  # integers: one rounding
        covariance[r["i"], r["j"]] = covariance[r["j"], r["i"]] = value
    return Moments(n, total, covariance)


class Inertia:
    """Counts of eigenvalues above a shift: the signs of the pivots of the shifted matrix, brought to tridiagonal form
    by reflections (which leave the inertia as it is)."""

    def __init__(self, matrix: np.ndarray):
        a, n = matrix.copy(), len(matrix)
        for k in range(n - 2):
            x = a[k + 1:, k].copy()
            if not x[1:].any():
                continue
            x[0] += np.copysign(np.linalg.norm(x), x[0])
            v = x / np.linalg.norm(x)
            head = a[k + 1:, k] - 2 * v * (v @ a[k + 1:, k])
            rest = a[k + 1:, k + 1:]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1:, k] = a[k, k + 1:] = head
        self.diagonal, self.squares = np.diag(a).tolist(), (np.diag(a, 1) ** 2).tolist()
        self.scale = float(np.abs(matrix).sum(1).max(initial=0.0))

    def above(self, shift: float) -> int:
        tiny, pivot, count = np.finfo(float).eps * self.scale or 1e-300, None, 0
        for i, d in enumerate(self.diagonal):
            pivot = d - shift - (self.squares[i - 1] / pivot if i else 0.0)
            if pivot == 0.0:
                pivot = -tiny
            count += pivot > 0
        return count

    def free(self, low: float, high: float) -> float | None:
        """A shift between the two that keeps a distance from every eigenvalue, or None."""
        for share in (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8, 0.45, 0.55):
            at, gap = low + share * (high - low), (high - low) * 1e-3
            if self.above(at - gap) == self.above(at + gap):
                return at
        return None

    def intervals(self, k: int, floor: float, per: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
        """``(low, high, count)`` with at most ``per`` eigenvalues (unless they are too close to part), which together
        hold the ``k`` greatest eigenvalues above ``floor``."""
        top = self.scale * (1 + 1e-9)
        low, high, k = floor, top, min(k, self.above(floor))
        if not k:
            return []
        for _ in range(200):
            if self.above(low) == k or high - low < 1e-13 * self.scale:
                break
            middle = self.free(low, high)
            if middle is None:
                break
            if self.above(middle) >= k:
                low = middle
            else:
                high = middle
        found, open_ = [], [(low, top)]
        while open_:
            a, b = open_.pop()
            count = self.above(a) - self.above(b)
            middle = self.free(a, b) if count > per and b - a > 1e-12 * self.scale else None
            if middle is not None:
                open_ += [(a, middle), (middle, b)]
            elif count:
                found.append((a, b, count))
        return found


def feast(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors between ``low`` and ``high``, of which there are ``count``."""
    width, scale = len(matrix), np.abs(matrix).sum(1).max()
    x, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (1 + x))
    centre, radius = (low + high) / 2, (high - low) / 2
    eye = np.eye(width)
    size, rng = min(width, 2 * count + 4), np.random.default_rng(width)
    accurate = 8 * np.finfo(float).eps * np.sqrt(width) * scale
    while True:
        block = rng.standard_normal((width, size))
        best, stale = np.inf, 0
        for _ in range(ROUNDS):
            projected = np.zeros((width, size))
            for w, t in zip(weights, turn, strict=True):
                solved = np.linalg.solve((centre + radius * t) * eye - matrix, block.astype(complex))
                projected += w / 2 * (radius * t * solved).real
            basis = np.linalg.qr(projected)[0]
            values, small = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ small
            inside = (values >= low) & (values < high)
            pairs = block[:, inside]
            left = np.linalg.norm(matrix @ pairs - pairs * values[inside], axis=0).max(initial=0.0)
            if inside.sum() == count:
                if left <= accurate:
                    return values[inside], pairs
                # rounding sets the last digit: accept what further rounds do not improve
                stale = stale + 1 if left >= best / 2 else 0
                best = min(best, left)
                if stale >= 2 and best <= 64 * accurate:
                    return values[inside], pairs
        if size == width:
            raise ArithmeticError(f"{count} eigenvalues between {low} and {high}, not all of them found")
        size = min(width, 2 * size)


def components(spark: SparkSession, covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues above zero and their unit eigenvectors (columns); a task per interval."""
    inertia = Inertia(covariance)
    parts = inertia.intervals(k, max(ZERO * float(np.trace(covariance)), 0.0))
    if not parts:
        return np.empty(0), np.empty((len(covariance), 0))
    shared = spark.sparkContext.broadcast(covariance)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                values, vectors = feast(shared.value, r.low, r.high, r.count)
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    jobs = spark.createDataFrame(parts, "low double, high double, count int").repartition(len(parts), "low")
    found = jobs.mapInPandas(solve, "value double, vector array<double>").collect()
    shared.unpersist()
    # intervals were solved apart: one Rayleigh-Ritz step over all makes their vectors orthogonal to the last digit
    basis = np.linalg.qr(np.array([r["vector"] for r in sorted(found, key=lambda r: -r["value"])]).T)[0]
    values, small = np.linalg.eigh(basis.T @ covariance @ basis)
    order = np.argsort(-values, kind="stable")[:k]
    return values[order], basis @ small[:, order]


def project(vectors: DataFrame, fitted: Moments, values: np.ndarray, axes: np.ndarray) -> DataFrame:
    """``vec_id, deviation, deviation_exact, whitened`` (an array by component) of every vector of the fitted width."""
    n, total = fitted.n, fitted.sums
    width, scaled = len(total), axes / np.sqrt(values)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    offset = np.array(total, object)
    narrow = max(map(abs, total)) < 1 << 62

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch, "x"):
                if narrow and n * _largest(x) < 1 << 62:
                    apart = n * x - offset.astype(np.int64)
                else:
                    apart = n * x.astype(object) - offset
                    if _largest(apart) < 1 << 62:
                        apart = apart.astype(np.int64)
                wide = width * _largest(apart) ** 2 >= 1 << 63
                exact = ((apart.astype(object) if wide else apart) ** 2).sum(1)
                white = (apart.astype(np.float64) / n) @ scaled
                yield pa.record_batch([
                    batch.column("vec_id").take(pa.array(at)),
                    pa.array([int(e) if e < 1 << 63 else None for e in exact], pa.int64()),
                    pa.array([decimal.Decimal(int(e)) if e < 10 ** 38 else None for e in exact], pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32), white.ravel()),
                ], ["vec_id", "deviation", "deviation_exact", "whitened"])

    return vectors.filter(F.size("x") == width).mapInArrow(
        of, f"vec_id {id_type}, deviation bigint, deviation_exact decimal(38,0), whitened array<double>")


def identity_error(projected: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity."""
    w = [F.get("whitened", i) for i in range(k)]
    cells = [F.abs(F.covar_pop(w[i], w[j]) - float(i == j)) for i in range(k) for j in range(i, k)]
    return projected.agg(F.array_max(F.array(*cells)).alias("e")).first()["e"]


def whiten(vectors: DataFrame, k: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, deviation_exact, whitened, explained, identity_error`` of every vector and
    component up to ``k``. ``vectors`` comes from ``integers``."""
    spark = vectors.sparkSession
    fitted = moments(vectors)
    values, axes = (np.empty(0), None) if fitted.covariance is None else components(spark, fitted.covariance, k)
    if not len(values):
        id_type = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], (
            f"vec_id {id_type}, component int, n bigint, deviation bigint, deviation_exact decimal(38,0), "
            "whitened double, explained double, identity_error double"))
    # read twice: once for the error, once for the rows
    rows = stored(project(vectors, fitted, values, axes), "whitened")
    error = identity_error(rows, len(values))
    shares = F.array(*(F.lit(float(v)) for v in values / np.trace(fitted.covariance)))
    return rows.select(
        "vec_id", "deviation", "deviation_exact", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("bigint").alias("n"), "deviation",
        "deviation_exact", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
