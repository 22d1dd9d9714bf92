"""Boosted trees grown in passes against plain loops over all rows."""

import math
import random

import numpy as np
import pytest

from fleets import quantile
from unitlife.operators import boosting
from unitlife.operators.quantiles import linspace_probabilities

SETTINGS = {"trees": 12, "rate": 0.3, "depth": 3, "least": 5, "rows_share": 0.8, "features_share": 0.7, "patience": 4, "seed": 7}


def rows(n, seed):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        a, b, c = draw.gauss(0, 1), draw.random(), float(draw.randrange(3))
        y = 2 * (a > 0.3) - b * c + draw.gauss(0, 0.1)
        out.append((None if draw.random() < 0.2 else a, b, c, None, y, None if draw.random() < 0.3 else -y + a))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "a double, b double, c double, never double, y double, z double")


FEATURES = ["a", "b", "c", "never"]


def side_sums(x, residual, cut, missing_left):
    left = (x != 0) & (x <= cut) | (x == 0) & missing_left
    return residual[left].sum(), left.sum(), residual[~left].sum(), (~left).sum(), left


def plain(train, keys, val, features, target, own, s):
    """The same growth with every row in one array: exact integers, all candidate splits in order."""
    column = {f: i for i, f in enumerate([*FEATURES, "y", "z"])}
    number = lambda data, f: np.array([math.nan if r[column[f]] is None else r[column[f]] for r in data])
    edges = {}
    for f in features:
        known = [r[column[f]] for r in train if r[column[f]] is not None]
        edges[f] = sorted({quantile(known, p) for p in linspace_probabilities(boosting.BINS - 1)})[1:] if known else []
    bins = {side: np.array([boosting.binned(number(data, f), edges[f]) for f in features]) for side, data in (("t", train), ("v", val))}
    y, yv = number(train, target), number(val, target)
    start, spread = np.nanmean(y), np.nanmax(y) - np.nanmin(y)
    scale = 2.0 ** min(36, 59 - math.ceil(math.log2(len(train) + 1))) / (4 * spread)
    at, atv = np.full(len(y), start), np.full(len(yv), start)
    allowed = np.array([f in own for f in features])
    forest, losses = [], []
    while len(forest) < s["trees"]:
        drawn = boosting.sampled(keys, len(forest), s["seed"], s["rows_share"]) & ~np.isnan(y)
        residual = np.rint(np.where(drawn, y - at, 0) * scale)
        chosen = boosting._subset(allowed, s["features_share"], s["seed"], len(forest))
        nodes = {0: np.ones(len(y), bool)}
        tree, leaves = {}, {}
        for node in range(2 ** s["depth"] - 1):
            inside = nodes[node] & drawn
            total, n = residual[inside].sum(), inside.sum()
            best = None
            for f in np.flatnonzero(chosen):
                for cut in range(1, boosting.BINS):
                    for missing_left in (True, False):
                        ls, ln, rs, rn, _ = side_sums(bins["t"][f][inside], residual[inside], cut, missing_left)
                        if ln < s["least"] or rn < s["least"]:
                            continue
                        gain = ls ** 2 / ln + rs ** 2 / rn - total ** 2 / n
                        if gain > 1e-9 * total ** 2 / n and (best is None or gain > best[0]):
                            best = gain, f, cut, missing_left
            _, f, cut, missing_left = best or (0, 0, boosting.NO_SPLIT, True)
            left = side_sums(bins["t"][f], residual, cut, missing_left or best is None)[4]
            tree[node] = (f, cut, best is not None and not missing_left)
            nodes[2 * node + 1], nodes[2 * node + 2] = nodes[node] & left, nodes[node] & ~left
        for leaf in range(2 ** s["depth"] - 1, 2 ** (s["depth"] + 1) - 1):
            inside = nodes[leaf] & drawn
            leaves[leaf] = s["rate"] * residual[inside].sum() / scale / max(inside.sum(), 1)
            at = at + np.where(nodes[leaf], leaves[leaf], 0)
        forest.append((tree, leaves))
        node = np.zeros(len(yv), int)
        for _ in range(s["depth"]):
            f, cut, right = (np.array([tree[k][i] for k in node]) for i in range(3))
            x = bins["v"][f, np.arange(len(yv))] if len(yv) else np.array([])
            node = 2 * node + 1 + ((x > cut) | (x == 0) & right)
        atv = atv + np.array([leaves[k] for k in node])
        losses.append(np.nanmean((yv - atv) ** 2) if (~np.isnan(yv)).any() else None)
        if losses[-1] is not None and len(losses) - boosting.best_iteration(losses, s["patience"]) >= s["patience"]:
            break
    keep = len(forest) if losses[-1] is None else boosting.best_iteration(losses, s["patience"])
    return edges, start, forest[:keep]


@pytest.mark.parametrize("block_rows, refresh, fan_in", [(1 << 14, 32, 64), (40, 3, 2)])
def test_forests_equal_plain_growth(spark, monkeypatch, block_rows, refresh, fan_in):
    for name, value in (("BLOCK_ROWS", block_rows), ("REFRESH", refresh), ("FAN_IN", fan_in)):
        monkeypatch.setattr(boosting, name, value)
    train, val = rows(300, 1), rows(80, 2)
    df, held_out = frame(spark, train).repartition(3), frame(spark, val)
    jobs = {"all": (FEATURES, "y"), "some": (["c", "b"], "y"), "gaps": (FEATURES, "z")}
    got = boosting.grow(df, held_out, jobs, **SETTINGS)
    keys = np.array([r.k for r in frame(spark, train).selectExpr("xxhash64(a, b, c, never, y, z) AS k").collect()], np.int64).astype(np.uint64)
    for name, (own, target) in jobs.items():
        edges, start, forest = plain(train, keys, val, FEATURES, target, own, SETTINGS)
        mine = got[name]
        assert mine.features == list(own) and mine.trees == len(forest) and mine.start == pytest.approx(start, abs=1e-12)
        for f, e in zip(mine.features, mine.edges, strict=True):
            assert e == pytest.approx(edges[f], abs=1e-12)
        for t, (tree, leaves) in enumerate(forest):
            for node, (f, cut, right) in tree.items():
                assert mine.cut[t, node] == cut and mine.missing_right[t, node] == right
                assert cut == boosting.NO_SPLIT or mine.features[mine.feature[t, node]] == FEATURES[f]
            assert mine.value[t] == pytest.approx([leaves[k] for k in sorted(leaves)], abs=1e-9)


def test_stops_on_validation_and_without(spark):
    train = frame(spark, rows(300, 1))
    noise = spark.createDataFrame([(0.0, 0.5, 1.0, None, 100.0, None)] * 20, train.schema)  # every tree makes it worse or better by nothing
    jobs = {"y": (FEATURES, "y")}
    assert boosting.grow(train, train.limit(0), jobs, **SETTINGS)["y"].trees == SETTINGS["trees"]
    assert 1 <= boosting.grow(train, noise, jobs, **SETTINGS)["y"].trees <= SETTINGS["trees"]
    assert boosting.grow(train.filter("y is null"), noise, jobs, **SETTINGS) == {}
    flat = train.selectExpr("a", "b", "c", "never", "1.5D AS y", "z")
    forest = boosting.grow(flat, flat, jobs, **SETTINGS)["y"]
    assert forest.start == 1.5 and not forest.value.any()


def test_scores_and_storage(spark, tmp_path):
    data = rows(200, 4)
    df = frame(spark, data)
    forests = boosting.grow(df, df.limit(0), {"y": (FEATURES, "y"), "z": (["b", "a"], "z")}, **SETTINGS)
    forests["z"].save(spark, f"{tmp_path}/z")
    again = forests | {"z": boosting.Forest.load(spark, f"{tmp_path}/z")}
    scored = boosting.scores(df, forests)
    assert scored.columns == [*df.columns, "y", "z"] or scored.columns[-2:] == ["y", "z"]
    named = {"p": forests["y"], "q": again["z"]}
    for r in boosting.scores(df, named).collect():
        for name, target in (("p", "y"), ("q", "z")):
            forest = forests[target]
            x = np.array([boosting.binned(np.array([math.nan if r[f] is None else r[f]]), e) for f, e in
                          zip(forest.features, forest.edges, strict=True)])
            assert r[name] == pytest.approx(forest.score(x)[0], abs=1e-12)
    error = [(r.p - r.y) ** 2 for r in boosting.scores(df, named).collect()]
    assert sum(error) < 0.3 * sum((r[4] - sum(x[4] for x in data) / 200) ** 2 for r in data)


def test_folders_are_removed(spark):
    import os

    from unitlife.session import shared_folder
    before = set(os.listdir(shared_folder(spark)))
    df = frame(spark, rows(100, 5))
    boosting.grow(df, df, {"y": (FEATURES, "y")}, **SETTINGS)
    left = {f for f in set(os.listdir(shared_folder(spark))) - before if f.startswith("boosting")}
    assert not left


def test_row_keys_decide_the_sample():
    keys = np.arange(100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    drawn = boosting.sampled(keys, 3, 42, 0.9)
    assert 0.895 < drawn.mean() < 0.905 and (boosting.sampled(keys[::-1], 3, 42, 0.9)[::-1] == drawn).all()
    assert (boosting.sampled(keys, 4, 42, 0.9) != drawn).any()


def test_below_the_root_at_most_half_the_rows_are_counted_by_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 8)
    passes, gather = [], boosting._gather

    def watched(blocks, parts, job):
        found = gather(blocks, parts, job)
        f = int(np.flatnonzero(job.chosen[0])[0])
        passes.append((job.level, int(found[1][0, :, f].sum()), blocks.getNumPartitions()))
        return found

    monkeypatch.setattr(boosting, "_gather", watched)
    df = frame(spark, rows(1500, 6))
    boosting.grow(df, df.limit(0), {"y": (FEATURES, "y")}, **SETTINGS)
    cores = spark.sparkContext.defaultParallelism
    assert max(tasks for *_, tasks in passes) <= max(2 * cores, 1500 / 8 / boosting.TASK_BLOCKS + 1)
    for level, counted, _ in passes:
        if level == 0:
            whole = counted
        assert 0 < counted <= (whole / 2 if level else 1500)


def test_other_children_are_the_rest_of_their_parents():
    parents = np.arange(12).reshape(2, 2, 3)
    found = parents // 3
    out = boosting._children(parents, np.array([True, False, False, True]), found)
    assert (out[[0, 3]] == found).all() and (out[[1, 2]] == parents - found).all()


@pytest.mark.parametrize("block_rows", [1 << 14, 40])
def test_forests_grown_in_passes_equal_plain_growth(spark, monkeypatch, block_rows):
    monkeypatch.setattr(boosting, "WHOLE_BLOCKS", 0)
    monkeypatch.setattr(boosting, "TILE_ROWS", 64)
    test_forests_equal_plain_growth(spark, monkeypatch, block_rows, 3, 2)


def test_forests_grown_whole_by_tiles_equal_plain_growth(spark, monkeypatch):
    monkeypatch.setattr(boosting, "TILE_ROWS", 64)
    test_forests_equal_plain_growth(spark, monkeypatch, 1 << 14, 32, 64)


def test_what_fits_a_task_takes_no_job_per_tree(spark):
    df = frame(spark, rows(300, 1))
    spark.sparkContext.setJobGroup("whole", "")
    try:
        forest = boosting.grow(df, df.limit(0), {"y": (FEATURES, "y")}, **SETTINGS | {"trees": 60})["y"]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert forest.trees == 60 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("whole")) < 60


def test_groups_of_features_count_as_each_alone(monkeypatch):
    monkeypatch.setattr(boosting, "TILE_ROWS", 30)
    monkeypatch.setattr(boosting, "EXACT_ROWS", 70)
    draw = np.random.default_rng(3)
    sizes = [33, 2, 5, 33, 33, 7]
    bins = np.array([draw.integers(0, size, 500) for size in sizes], np.uint8)
    parent, whole = draw.integers(0, 4, 500), draw.integers(-2 ** 35, 2 ** 35, 500).astype(float)
    chosen = np.flatnonzero(draw.random(500) < 0.6)
    groups = boosting.joined(sizes)
    assert sorted(f for g in groups for f in g) == list(range(6)) and len(groups) < 6
    assert all(math.prod(sizes[f] for f in g) <= boosting.JOINT_CELLS for g in groups)
    seen = boosting._Histogram(sizes, np.ones(6, bool), 4)
    seen.add([boosting._code(bins, sizes, g) for g in groups], chosen, parent[chosen], whole[chosen])
    sums, counts = seen.tables()
    for f, size in enumerate(sizes):
        for p in range(4):
            for b in range(size):
                here = chosen[(parent[chosen] == p) & (bins[f][chosen] == b)]
                assert sums[p, f, b] == whole[here].sum() and counts[p, f, b] == len(here)
