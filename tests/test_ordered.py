"""Chunked per-unit computation against a plain walk over each unit, with one unit far larger."""

import random

import pytest
from pyspark.sql import functions as F

from unitlife.operators.ordered import (
    CHUNK, ensure_chunk, join_on_units, neighbours, place, running, unit_values, with_ordinal,
)


def history(gap=1, seed=3):
    draw = random.Random(seed)
    rows = []
    for unit, n in {"hot": 97, "a": 1, "b": 5, "c": 12}.items():
        at = 0
        for _ in range(n):
            at += draw.randint(1, gap)
            event = draw.choice(["set", "clear", "none", "none"])
            rows.append((unit, at, draw.randint(1, 9), event))
    draw.shuffle(rows)
    return rows


@pytest.fixture(scope="module", params=[1, 40])
def rows(request):
    return history(request.param)


def walk(rows):
    out = {}
    for unit in {r[0] for r in rows}:
        total, seen, held = 0, 0, None
        for _, at, value, event in sorted(r for r in rows if r[0] == unit):
            out[unit, at] = (total, seen, held)
            total, seen = total + value, seen + 1
            held = value if event == "set" else None if event == "clear" else held
    return out


@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize("chunk_rows", [1, 7, 1000])
def test_running_equals_a_walk(spark, rows, dense, chunk_rows):
    df = spark.createDataFrame(rows, "unit string, at int, value int, event string")
    event = F.col("event").isin("set", "clear")
    got = running(
        df, ["unit"], "at", dense=dense, chunk_rows=chunk_rows,
        sums={"total": F.col("value"), "seen": F.lit(1)},
        last_of=(event, {"held": F.when(F.col("event") == "set", F.col("value"))})).collect()
    assert {(r.unit, r.at): (r.total, r.seen, r.held) for r in got} == walk(rows)
    assert CHUNK not in got[0].asDict()


@pytest.mark.parametrize("chunk_rows", [3, 1000])
def test_ordinals_are_dense(spark, rows, chunk_rows):
    df = spark.createDataFrame(rows, "unit string, at int, value int, event string")
    got = with_ordinal(df, ["unit"], "at", "n", chunk_rows=chunk_rows).collect()
    for unit in {r.unit for r in got}:
        assert [r.n for r in sorted((r for r in got if r.unit == unit), key=lambda r: r.at)] == list(
            range(1, sum(r.unit == unit for r in got) + 1))


@pytest.mark.parametrize("chunk_rows", [2, 5, 16, 1000])
def test_neighbours_cross_chunk_borders(spark, chunk_rows):
    sizes = {"hot": 83, "a": 1, "b": 6}
    df = spark.createDataFrame([(u, i, i * i) for u, n in sizes.items() for i in range(1, n + 1)],
                               "unit string, at int, y int")
    got = neighbours(df, ["unit"], "at", before=5, after=7, chunk_rows=chunk_rows, columns={
        "previous": lambda w: F.lag("y").over(w),
        "trailing": lambda w: F.sum("y").over(w.rowsBetween(-5, -1)),
        "ahead": lambda w: F.lead("y", 7).over(w)}).collect()
    assert len(got) == sum(sizes.values())
    for r in got:
        n, i = sizes[r.unit], r["at"]
        assert r.previous == ((i - 1) ** 2 if i > 1 else None)
        assert r.trailing == (sum(j * j for j in range(max(1, i - 5), i)) or None)
        assert r.ahead == ((i + 7) ** 2 if i + 7 <= n else None)


def test_no_task_gets_more_than_a_chunk(spark):
    df = spark.range(1, 2001).select(F.lit("hot").alias("unit"), F.col("id").alias("at"))
    got = neighbours(df, ["unit"], "at", before=5, chunk_rows=100, keep_chunk=True,
                     columns={"previous": lambda w: F.lag("at").over(w)})
    sizes = got.groupBy("unit", CHUNK).count().collect()
    assert len(sizes) == 20 and all(r["count"] == 100 for r in sizes)
    assert "Window" in got._jdf.queryExecution().executedPlan().toString()


def test_plain_window_only_if_every_unit_is_small(spark):
    df = spark.createDataFrame([("hot", i) for i in range(50)] + [("a", 1)], "unit string, at int")
    plan = lambda **o: running(
        df, ["unit"], "at", sums={"n": F.lit(1)}, **o)._jdf.queryExecution().executedPlan().toString()
    for dense in (True, False):
        assert "Join" not in plan(dense=dense, chunk_rows=50)
        assert "Join" in plan(dense=dense, chunk_rows=10)
        assert "Join" not in plan(dense=dense, chunk_rows=10, small=True)


def test_unit_values_and_dimension_join(spark):
    df = spark.createDataFrame([(u, i) for u, n in {"hot": 50, "a": 3}.items() for i in range(1, n + 1)],
                               "unit string, at int")
    chunked = ensure_chunk(df, "at", 8)
    grains = unit_values(chunked, ["unit"], {"top": (F.max("at"), F.max), "n": (F.count("*"), F.sum)})
    rows = chunked.join(grains, ["unit", CHUNK]).collect()
    assert len(rows) == 53
    assert all((r.top, r.n) == ((50, 50) if r.unit == "hot" else (3, 3)) for r in rows)
    dimension = spark.createDataFrame([("hot", "x")], "unit string, label string")
    assert join_on_units(chunked, dimension, ["unit"]).filter("label = 'x'").count() == 50
    assert join_on_units(chunked, dimension, ["unit"], "left").filter("label is null").count() == 3


def test_sparse_order_makes_chunks_by_rows(spark):
    rows = [("long", i * (1 << 21) + 5) for i in range(200)] + [("short", i) for i in range(50)]
    df = spark.createDataFrame(rows, "unit string, at long")
    placed = place(df, ["unit"], "at", dense=False, chunk_rows=100)
    sizes = {(r.unit, r[CHUNK]): r["count"] for r in placed.groupBy("unit", CHUNK).count().collect()}
    assert max(sizes.values()) <= 100 and len(sizes) == 5 and sizes["short", 0] == 50
    got = with_ordinal(df, ["unit"], "at", "n", chunk_rows=100).collect()
    assert all(r.n == (r["at"] - 5 >> 21) + 1 for r in got if r.unit == "long")


@pytest.mark.parametrize("kind", ["outlier", "bursts", "two ends", "powers", "even"])
def test_skewed_orders_make_chunks_by_rank(spark, kind):
    """No chunk over its rows, chunks in the order's order, and accumulation unchanged."""
    draw = random.Random(4)
    orders = {
        "outlier": [*range(999), 1 << 60],
        "bursts": sorted({b * 10 ** 12 + draw.randrange(400) for b in range(5) for _ in range(200)}),
        "two ends": [*range(-(1 << 40), 500 - (1 << 40)), *range(1 << 40, (1 << 40) + 500)],
        "powers": [2 ** i + j for i in range(4, 60) for j in range(10)],
        "even": list(range(0, 7000, 7)),
    }[kind]
    df = spark.createDataFrame([("hot", o, 1) for o in orders] + [("a", 3, 1)], "unit string, at long, _cell0 int")
    df = df.select("unit", "at")
    placed = place(df, ["unit"], "at", dense=False, chunk_rows=100)
    assert placed.columns == ["unit", "at", CHUNK]
    rows = sorted(placed.filter("unit = 'hot'").collect(), key=lambda r: r["at"])
    assert [r["at"] for r in rows] == sorted(orders)
    chunks = [r[CHUNK] for r in rows]
    assert chunks == sorted(chunks) and max(chunks.count(c) for c in set(chunks)) <= 100
    assert len(set(chunks)) <= 2 * len(orders) // 50 + 2
    got = {r["at"]: r.n for r in with_ordinal(df, ["unit"], "at", "n", chunk_rows=100).filter("unit = 'hot'").collect()}
    assert got == {o: i for i, o in enumerate(sorted(orders), 1)}
