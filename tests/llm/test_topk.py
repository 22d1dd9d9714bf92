"""MaxScore against scoring everything."""

import math
import random

import numpy as np
import pytest

from unitlife.llm import topk


def brute(rows, k, divisor):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for q, v in usable:
        if q % divisor == 0:
            best = sorted((-dot(v, w), i) for i, w in usable if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return sorted(out)


def rows(seed=1, n=300):
    rng = random.Random(seed)
    common = [rng.uniform(-1, 1) for _ in range(8)]
    out = [(i, common if rng.random() < 0.3 else [rng.uniform(-1, 1) for _ in range(8)]) for i in range(n)]
    return out + [(1000, None), (1010, [1.0, None] + [0.0] * 6), (1020, [math.nan] * 8), (1030, [math.inf] * 8), (None, common),
                  (1040, [0.5, -0.5]), (1050, []), (10, out[10][1])]


@pytest.mark.parametrize("shard_rows, block_rows, stride", [(1 << 17, 1 << 10, 2048), (7, 3, 4)])
def test_against_all_scores(spark, monkeypatch, shard_rows, block_rows, stride):
    df = spark.createDataFrame([(i, v, 5) for i, v in rows()], "vec_id long, embedding array<float>, score int")
    data = [(r.vec_id, r.embedding) for r in df.collect()]
    vectors = topk.integers(df)
    got = topk.search(vectors.filter("vec_id % 10 = 0"), vectors, 5, shard_rows, block_rows).collect()
    assert sorted(map(tuple, got)) == brute(data, 5, 10)


def test_shard_prunes_exactly(monkeypatch):
    monkeypatch.setattr(topk, "STRIDE", 16)
    rng = np.random.default_rng(4)
    for spread in (1, 50, 1 << 20):
        cells = (rng.normal(size=(500, 12)) * np.geomspace(1, 1e-3, 12) * 100 * spread).astype(np.int64)
        shard = topk.Shard(np.arange(500) * 3, cells)
        for q in cells[:20]:
            scores = cells @ q
            want = sorted(zip((-scores).tolist(), shard.ids.tolist(), strict=True))[:6]
            ids, found = shard.top(q, -1, 6, shard.typed(q[None]))
            assert [(-s, i) for i, s in zip(ids.tolist(), found.tolist(), strict=True)] == want


def test_fewer_rows_than_asked_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<double>")
    vectors = topk.integers(df)
    assert sorted(map(tuple, topk.search(vectors, vectors, 5).collect())) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
    none = vectors.filter("false")
    assert topk.search(none, none, 5).collect() == [] == topk.search(none, vectors, 5).collect()


@pytest.mark.parametrize("large", [9_000_000.0, 1e7, 1e12])
def test_large_components_do_not_wrap(spark, large):
    """Beyond 32 bits, beyond exact doubles, and products beyond a long on the way to a score within it."""
    rng = random.Random(3)
    data = [(i, [large * rng.choice([-1, 1, 0.5]) if large < 1e12 else large * (i == 7), rng.uniform(-1, 1), float(i)]) for i in range(40)]
    data.append((50, [1.0, 2.0, 3.0]))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    vectors = topk.integers(df)
    queries = vectors.filter("vec_id % 10 = 0")
    assert sorted(map(tuple, topk.search(queries, vectors, 5).collect())) == brute(data, 5, 10)
