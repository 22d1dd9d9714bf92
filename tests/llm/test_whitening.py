"""FEAST whitening against exact integers and a dense eigensolver."""

import math
from fractions import Fraction

import numpy as np
import pytest

from unitlife.llm import whitening


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows],
                                 "vec_id long, embedding array<double>, component string, whitened double")


def rows_of(n=200, width=12, seed=3):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, width)) * np.geomspace(3, 0.05, width) @ np.linalg.qr(rng.normal(size=(width, width)))[0]
    return [(int(i), v.tolist()) for i, v in enumerate(mixed)]


def usable(rows, width):
    return [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in rows
            if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]


def check(got, rows, width, k):
    kept = usable(rows, width)
    n = len(kept)
    total = [sum(x[d] for _, x in kept) for d in range(width)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, total, strict=True)] for _, x in kept])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == n * k and {r.component for r in got} == set(range(1, k + 1))
    for c in range(k):
        own = sorted((r for r in got if r.component == c + 1), key=lambda r: (r.vec_id is None, r.vec_id, r.whitened))
        theirs = centred @ axes[:, c] / math.sqrt(values[c])
        mine = np.array(sorted(r.whitened for r in own))
        assert min(np.abs(mine - np.sort(s * theirs)).max() for s in (1, -1)) < 1e-8
        assert own[0].explained == pytest.approx(values[c] / values.sum(), rel=1e-10)
    exact = sorted(sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True)) for _, x in kept for _ in range(k))
    assert sorted(r.deviation for r in got) == exact == sorted(int(r.deviation_exact) for r in got)
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9


def test_against_dense_solver(spark):
    rows = rows_of()
    odd = [(900, None), (901, [1.0] * 11 + [None]), (902, [math.nan] * 12), (903, [math.inf] + [0.0] * 11), (904, [1.0]),
           (905, []), (None, rows[3][1]), (7, rows[7][1]), (7, rows[7][1]), (906, [1e300] * 12)]
    got = whitening.whiten(whitening.integers(frame(spark, rows + odd[:-1]))).collect()
    check(got, rows + odd[:-1], 12, 8)
    assert len(whitening.whiten(whitening.integers(frame(spark, rows + odd))).collect()) == len(got)


def test_fewer_components_than_asked(spark):
    """Vectors that span two dimensions, then none, then an empty table."""
    flat = [(i, [i / 8, (i * i % 7) / 8, 0.0, 0.25]) for i in range(20)]
    got = whitening.whiten(whitening.integers(frame(spark, flat))).collect()
    check(got, flat, 4, 2)
    for rows in ([(i, [0.5, 0.5]) for i in range(5)], [(1, [0.5])], [(1, [])], [(1, None)], []):
        out = whitening.whiten(whitening.integers(frame(spark, rows)))
        assert out.collect() == [] and out.columns[:3] == ["vec_id", "component", "n"]


def test_equal_eigenvalues(spark):
    """A cross has one eigenvalue many times: any orthonormal basis, all copies found."""
    rows = [(2 * d + s, [(2 * s - 1.0) if i == d else 0.0 for i in range(12)]) for d in range(12) for s in (0, 1)]
    got = whitening.whiten(whitening.integers(frame(spark, rows))).collect()
    assert len(got) == 24 * 8 and max(r.identity_error for r in got) < 1e-9
    assert {round(r.explained, 9) for r in got} == {round(1 / 12, 9)}


def test_large_integers_stay_exact(spark):
    rows = [(i, [float(1 << 40) * ((i * 37) % 11), 0.5 * i, -float(i % 3)]) for i in range(30)]
    got = whitening.whiten(whitening.integers(frame(spark, rows)), 1).collect()
    kept = usable(rows, 3)
    n, total = len(kept), [sum(x[d] for _, x in kept) for d in range(3)]
    want = {i: sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True)) for i, x in kept}
    assert {r.vec_id: int(r.deviation_exact) for r in got} == want
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None) for r in got)


def test_gram_is_exact():
    rng = np.random.default_rng(1)
    for bits in (5, 19, 20, 21, 45, 61):
        y = rng.integers(-(1 << bits), 1 << bits, (70, 5))
        big = y.astype(object)
        assert (whitening.gram(y) == big.T @ big).all()


@pytest.mark.parametrize("spread", [1.0, 1e-3, 1e-9])
def test_intervals_and_feast_find_all(spread):
    rng = np.random.default_rng(5)
    for width in (1, 2, 3, 9, 40):
        basis = np.linalg.qr(rng.normal(size=(width, width)))[0]
        values = np.sort(np.concatenate([np.full(width // 3, 2.0), 1 + spread * rng.random(width - width // 3)]))[::-1]
        matrix = basis * values @ basis.T
        matrix = (matrix + matrix.T) / 2
        inertia = whitening.Inertia(matrix)
        for shift in (0.5, 1.5, 3.0):
            assert inertia.above(shift) == (values > shift).sum()
        k = min(8, width)
        parts = inertia.intervals(k, 1e-12)
        assert sum(c for _, _, c in parts) >= k
        found = np.sort(np.concatenate([whitening.feast(matrix, *p)[0] for p in parts]))[::-1][:k]
        assert np.abs(found - values[:k]).max() < 1e-13 * 8


def test_feast_meets_its_count():
    matrix = np.diag([1.0, 2.0, 3.0])
    with pytest.raises(ArithmeticError):
        whitening.feast(matrix, 1.5, 2.5, 2)
