import random

import pytest

from fleets import close, quantile
from unitlife.operators import drift
from unitlife.operators.quantiles import column_order, column_ranks, grouped_quantiles, interpolated, linspace_probabilities


def samples(kind, n=3000, seed=1):
    draw = random.Random(seed)
    return {
        "normal": lambda: [draw.gauss(0, 1) for _ in range(n)],
        "ties": lambda: [float(draw.randint(0, 4)) for _ in range(n)],
        "constant": lambda: [3.0] * n,
        "wide": lambda: [10.0 ** draw.uniform(-30, 30) for _ in range(n)],
        "hot value": lambda: [0.5] * (n // 2) + [draw.random() for _ in range(n // 2)],
        "one outlier": lambda: [draw.random() for _ in range(n - 1)] + [1e300],
        "negative": lambda: [-draw.expovariate(1) for _ in range(n)],
    }[kind]()


KINDS = ["normal", "ties", "constant", "wide", "hot value", "one outlier", "negative"]


def test_linspace_keeps_the_exact_doubles():
    assert linspace_probabilities(10)[3] == 0.30000000000000004
    assert linspace_probabilities(10)[-1] == 1.0


@pytest.mark.parametrize("limit,cells", [(1 << 20, 64), (50, 64), (1, 8)])
def test_grouped_quantiles_are_exact(spark, limit, cells):
    data = {k: samples(k, 3000 if limit > 1 else 120) for k in KINDS} | {"small": [2.0, 1.0], "single": [9.0]}
    rows = [(k, x) for k, xs in data.items() for x in xs] + [("normal", None), ("empty", None)]
    df = spark.createDataFrame(rows, "feature string, x double").repartition(4)
    p = linspace_probabilities(10)
    got = {r.feature: r for r in grouped_quantiles(df, ["feature"], "x", p, limit=limit, cells=cells).collect()}
    assert set(got) == set(data)
    for kind, xs in data.items():
        assert got[kind].n == len(xs)
        for q, value in zip(p, got[kind].quantiles):
            assert close(value, quantile(xs, q), 1e-12), (kind, q)


def test_a_known_bound_skips_the_count(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)], "feature string, x double")
    bounded = grouped_quantiles(df, ["feature"], "x", [0.5], limit=100, at_most=100)
    narrowed = grouped_quantiles(df, ["feature"], "x", [0.5], limit=10, at_most=100)
    assert bounded.first().quantiles == narrowed.first().quantiles == [49.5]


@pytest.mark.parametrize("limit", [1 << 20, 5000, 50, 1])
def test_large_columns_are_narrowed_without_a_row_per_value(spark, monkeypatch, limit):
    def unpivoted(*args):
        raise AssertionError("a row per value")

    monkeypatch.setattr(drift, "long_form", unpivoted)
    data = [samples(kind) for kind in KINDS]
    rows = [[None if i == 3 and k % 7 == 0 else x for i, x in enumerate(row)] + [None] for k, row in enumerate(zip(*data, strict=True))]
    names = [*KINDS, "infinite"]
    for k, row in enumerate(rows):
        row[-1] = (float("inf"), -float("inf"), float("nan"), k / 7)[min(k % 40, 3)]
    df = spark.createDataFrame(rows, ", ".join(f"`{name}` double" for name in names)).repartition(4)
    p = linspace_probabilities(8)
    for i, got in enumerate(drift.column_quantiles(df, names, p, limit)):
        xs = [row[i] for row in rows if row[i] is not None and row[i] == row[i]]
        assert got.n == len(xs)
        for q, value in zip(p, got.quantiles, strict=True):
            assert close(value, quantile(xs, q), 1e-12) or value == quantile(xs, q), (names[i], q)


def test_order_statistics_by_mask(spark):
    rows = [(float(k % 97), k / 3 if k % 5 else None, k % 2 == 0, k % 3 == 0, False) for k in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, even boolean, third boolean, never boolean").repartition(3)
    for listed in (1 << 16, 1):
        got = column_order(df, ["a", "b"], [(0.0, 96.0), (1 / 3, 2999 / 3)], column_ranks([0.5]), ["even", "third", "never"], listed=listed, cells=16)
        for i in (0, 1):
            for j in (0, 1, 2):
                xs = [row[i] for row in rows if row[2 + j] and row[i] is not None]
                n, at = got[i, j]
                assert n == len(xs)
                assert interpolated(n, at, [0.5]) == ([pytest.approx(quantile(xs, 0.5))] if xs else None)
