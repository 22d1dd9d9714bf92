"""Gradient-boosted regression trees, grown for many targets in the same passes.

Features are cut into bins by exact quantiles of the training rows; a missing value has a bin of its own and goes to
the side of a split that suits it better. Rows travel as blocks of bins and current residuals, and a level of a tree needs one
pass over them. Below the root only the smaller child of each node is counted, over the features drawn for the tree; the other
child is the rest of its parent. Residuals are rounded to integers that add up exactly, so neither the partitioning nor a
lost executor changes a tree, and both ways to grow give the same trees:

* Up to the rows of ``WHOLE_BLOCKS`` full blocks, and ``WHOLE_BYTES`` for those of a target, each forest is a task of its
  own: it reads all blocks once and passes over them in its memory. All forests take one Spark job.
* Above that the rows of every pass are dealt over all tasks. One pass serves a level of the current tree of *every* target:
  each task adds up its rows' residuals per (target, node, feature, bin), the sums are added up, and the driver, which sees no
  rows, chooses the splits. The number of passes follows the longest forest and not the number of targets. Every ``REFRESH``
  trees the blocks are checkpointed anew with their residuals, which ends their lineage, and the folder before is removed.

Growth stops on the validation rows while it goes on: a target leaves once ``patience`` trees have not lowered its
validation loss, and its forest is cut to the leading trees with the lowest loss; nothing is fitted twice.
"""

from __future__ import annotations

import math
import uuid
from collections import OrderedDict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitlife.operators.drift import column_quantiles
from unitlife.operators.quantiles import linspace_probabilities
from unitlife.session import remove_folder, use_checkpoints

BINS = 32
BLOCK_ROWS = 1 << 16
TASK_BLOCKS = 64  # at most, on average
REFRESH = 16
FAN_IN = 64  # histograms that one task or the driver adds up
HELD_BYTES = 1 << 27
WHOLE_BLOCKS = 96  # a forest of at most so many full blocks is grown in one task,
WHOLE_BYTES = 3 << 27  # if its rows take no more there
TILE_ROWS = 1 << 15  # counted at once
EXACT_ROWS = 1 << 17  # added up in floating point, where the whole numbers that residuals are rounded to stay exact
JOINT_CELLS = (BINS + 1) ** 2
NO_SPLIT = 255  # every bin is below

_BLOCK = "block string, n bigint, bins binary, held_out binary, keys binary, residuals binary"


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth: per tree and node a feature, the last bin that goes left and where missing
    values go; per tree and leaf a value."""

    features: list[str]
    edges: list[list[float]]
    start: float
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    missing_right: np.ndarray
    value: np.ndarray

    @property
    def trees(self) -> int:
        return len(self.value)

    def leading(self, trees: int) -> Forest:
        return Forest(self.features, self.edges, self.start, self.depth, self.feature[:trees], self.cut[:trees],
                      self.missing_right[:trees], self.value[:trees])

    def score(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(bins.shape[1], self.start)
        for t in range(self.trees):
            out += self.value[t][route(bins, self.feature[t], self.cut[t], self.missing_right[t], self.depth)]
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(
            self.features, self.edges, self.start, self.depth, self.feature.ravel().tolist(), self.cut.ravel().tolist(),
            self.missing_right.ravel().tolist(), self.value.ravel().tolist())], FOREST).coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        r = spark.read.schema(FOREST).parquet(path).first()
        shaped = lambda name, kind, width: np.array(r[name], kind).reshape(-1, width)
        nodes = 2 ** r["depth"] - 1
        return cls(r["features"], [list(e) for e in r["edges"]], r["start"], r["depth"], shaped("feature", np.int16, nodes),
                   shaped("cut", np.uint8, nodes), shaped("missing_right", bool, nodes), shaped("value", float, nodes + 1))


FOREST = ("features array<string>, edges array<array<double>>, start double, depth int, feature array<int>, cut array<int>, "
          "missing_right array<boolean>, value array<double>")


def binned(values: np.ndarray, edges: Sequence[float]) -> np.ndarray:
    """0 for a missing value, else one more than the number of edges at or below."""
    return np.where(np.isnan(values), 0, np.searchsorted(edges, values, side="right") + 1).astype(np.uint8)


def descended(bins: np.ndarray, node: np.ndarray, level: int, feature: np.ndarray, cut: np.ndarray,
              missing_right: np.ndarray) -> np.ndarray:
    """Number, within the next level, of the node that each row reaches from its ``node`` of a level."""
    right = np.zeros(bins.shape[1], bool)
    for i in range(2 ** level):
        at = 2 ** level - 1 + i
        if cut[at] == NO_SPLIT:
            continue
        x = bins[feature[at]]
        goes = x > cut[at]
        if missing_right[at]:
            goes |= x == 0
        if level:
            goes &= node == i
        right |= goes
    return 2 * node + right


def _at_root(rows: int, levels: int) -> np.ndarray:
    return np.zeros(rows, np.uint8 if levels <= 8 else np.intp)


def route(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, missing_right: np.ndarray, levels: int) -> np.ndarray:
    """Number, within its level, of the node that each row reaches after ``levels`` splits."""
    node = _at_root(bins.shape[1], levels)
    for level in range(levels):
        node = descended(bins, node, level, feature, cut, missing_right)
    return node


def sampled(keys: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Rows drawn for a tree, by their keys alone (a fixed mixing of 64 bits)."""
    with np.errstate(over="ignore"):
        x = keys ^ (np.uint64((seed << 32) + tree + 1) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) < share * 2.0 ** 53


def _tiles(rows: int) -> list[slice]:
    return [slice(at, at + TILE_ROWS) for at in range(0, rows, TILE_ROWS)]


def joined(sizes: Sequence[int], most: int = JOINT_CELLS) -> list[list[int]]:
    """Groups of features, given their numbers of bins, whose bins together make at most ``most`` cells (one feature may exceed it)."""
    groups: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        fitting = (g for g in groups if math.prod(sizes[i] for i in g) * sizes[f] <= most)
        group = next(fitting, None)
        if group is None:
            groups.append(group := [])
        group.append(f)
    return groups


def _code(bins: np.ndarray, sizes: Sequence[int], group: Sequence[int]) -> np.ndarray:
    """The cell of a group of features that a row falls into."""
    code = bins[group[0]].astype(np.uint16)
    for f in group[1:]:
        code = code * np.uint16(sizes[f]) + bins[f]
    return code


class _Histogram:
    """Sums and counts by (parent, feature, bin). A row adds once to the cells of each group of features, and those are
    added up by feature at the end. ``wanted`` are the features drawn; groups without any are left out."""

    def __init__(self, sizes: Sequence[int], wanted: np.ndarray, parents: int):
        self.sizes, self.parents = sizes, parents
        self.groups = [(i, g, math.prod(sizes[f] for f in g)) for i, g in enumerate(joined(sizes)) if wanted[g].any()]
        self.sums = [np.zeros(parents * width, np.int64) for *_, width in self.groups]
        self.counts = [np.zeros_like(s) for s in self.sums]
        self.cells = [np.zeros(parents * width, complex) for *_, width in self.groups]
        self.added = 0

    def add(self, codes: Sequence[np.ndarray], chosen: np.ndarray, parent: np.ndarray | None, whole: np.ndarray) -> None:
        """Adds the ``chosen`` rows, whose ``codes`` are one array per group."""
        for at in _tiles(len(chosen)):
            rows = chosen[at]
            if self.added + len(rows) > EXACT_ROWS:
                self._settle()
            self.added += len(rows)
            weights = np.empty(len(rows), complex)
            weights.real, weights.imag = whole[at], 1
            for k, (i, _, width) in enumerate(self.groups):
                place = codes[i].take(rows)
                if parent is not None:
                    place = place + parent[at].astype(np.min_scalar_type(self.parents * width)) * width
                np.add.at(self.cells[k], place.astype(np.intp), weights)

    def _settle(self) -> None:
        for cells, sums, counts in zip(self.cells, self.sums, self.counts, strict=True):
            sums += cells.real.astype(np.int64)
            counts += cells.imag.astype(np.int64)
            cells[:] = 0
        self.added = 0

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        self._settle()
        out = np.zeros((2, self.parents, len(self.sizes), BINS + 1), np.int64)
        for k, (_, group, _) in enumerate(self.groups):
            shape = (self.parents, *(self.sizes[f] for f in group))
            for kind, cells in zip(out, (self.sums[k], self.counts[k]), strict=True):
                for j, f in enumerate(group, 1):
                    others = tuple(a for a in range(1, len(shape)) if a != j)
                    kind[:, f, :self.sizes[f]] = cells.reshape(shape).sum(others)
        return out[0], out[1]


@dataclass
class _Pass:
    """What a pass over the blocks needs to know. Trees are ``(feature, cut, missing_right, value)``, a row per target."""

    run: str
    targets: int
    sizes: list[int]  # bins of every feature
    active: list[int]
    since: int  # trees that the stored residuals leave behind
    trees: list[tuple]  # those after that
    tree: int
    depth: int
    level: int
    growing: tuple  # (feature, cut, missing_right) of the current tree
    chosen: np.ndarray  # features of the current tree, a row per target
    counted: np.ndarray  # whether a node of this level is counted, a row per target
    scale: np.ndarray
    seed: int
    share: float


# Residuals that a worker has made, so that the next pass takes off the latest trees alone. Losing them costs time only.
_held: OrderedDict[tuple[str, str], tuple[int, np.ndarray]] = OrderedDict()


def _residuals(job: _Pass, block: str, bins: np.ndarray, stored: np.ndarray) -> np.ndarray:
    done, out = _held.pop((job.run, block), (-1, None))
    if out is None or done < job.since:
        done, out = job.since, stored.copy()
    for *splits, value in job.trees[done - job.since:]:
        for m in job.active:
            out[m] -= value[m].take(route(bins, *(x[m] for x in splits), job.depth))
    _held[job.run, block] = (job.since + len(job.trees), out)
    while len(_held) > 1 and sum(p.nbytes for _, p in _held.values()) > HELD_BYTES:
        _held.popitem(last=False)
    return out


def _read(job: _Pass, row: tuple):
    block, n, bins, held_out, keys, stored = row
    bins = np.frombuffer(bins, np.uint8).reshape(len(job.sizes), n)
    stored = np.frombuffer(stored, np.float64).reshape(job.targets, n)
    return bins, np.frombuffer(held_out, bool), np.frombuffer(keys, np.uint64), _residuals(job, block, bins, stored)


def _sums(job: _Pass):
    """Per task: residual sums and counts by (target, parent of a counted node, feature, bin), then validation losses and counts."""
    def add(rows: Iterator[tuple]) -> Iterator[tuple]:
        parents = 2 ** max(job.level - 1, 0)
        found = [_Histogram(job.sizes, job.chosen[m], parents) for m in job.active]
        losses = np.zeros((len(job.active), 2))
        for row in rows:
            bins, held_out, keys, residuals = _read(job, row)
            drawn = ~held_out & sampled(keys, job.tree, job.seed, job.share)
            codes = [_code(bins, job.sizes, g) for g in joined(job.sizes)]
            for a, m in enumerate(job.active):
                known = ~np.isnan(residuals[m])
                if job.level == 0:
                    error = residuals[m][held_out & known]
                    losses[a] += error @ error, len(error)
                inside = drawn & known
                if job.level:
                    node = route(bins, *(x[m] for x in job.growing), job.level)
                    inside &= job.counted[m].take(node)
                chosen = np.flatnonzero(inside)
                whole = np.rint(residuals[m].take(chosen) * job.scale[m])
                parent = node.take(chosen) >> 1 if job.level else None
                found[a].add(codes, chosen, parent, whole)
        sums, counts = (np.stack(x) for x in zip(*[h.tables() for h in found], strict=True))
        yield sums, counts, losses
    return add


def _added(one: tuple, other: tuple) -> tuple:
    return tuple(a + b for a, b in zip(one, other, strict=True))


def _gather(blocks: RDD, parts: int, job: _Pass) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = blocks.mapPartitions(_sums(job))
    if parts > FAN_IN:
        return found.treeReduce(_added, math.ceil(math.log(parts, FAN_IN)))
    return reduce(_added, found.collect())


def _children(parents: np.ndarray, counted: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Per node of a level what it holds, from its parents and from the one child of each that was counted."""
    out = np.empty((2 * len(parents), *parents.shape[1:]), parents.dtype)
    out[counted], out[~counted] = found, parents - found
    return out


def best_splits(sums: np.ndarray, counts: np.ndarray, allowed: np.ndarray, least: int):
    """Per node of one target: ``(feature, cut, missing_right, left and right sums and counts)``.

    ``sums`` and ``counts`` are (node, feature, bin). Of equal gains the first feature, then the lowest cut, then missing
    values to the left. A node that no split improves sends everything left.
    """
    first = int(np.argmax(allowed))  # what is not allowed may not have been counted
    total, n = sums[:, first].sum(1), counts[:, first].sum(1)
    low_s, low_n = np.cumsum(sums[..., 1:-1], -1), np.cumsum(counts[..., 1:-1], -1)
    # missing values to the left, then to the right
    left_s = np.stack([low_s + sums[..., :1], low_s], -1)
    left_n = np.stack([low_n + counts[..., :1], low_n], -1)
    right_s, right_n = total[:, None, None, None] - left_s, n[:, None, None, None] - left_n
    share = lambda s, c: s.astype(float) ** 2 / np.maximum(c, 1)
    whole = share(total, n)[:, None, None, None]
    gain = share(left_s, left_n) + share(right_s, right_n) - whole
    fits = (left_n >= least) & (right_n >= least) & allowed[None, :, None, None]
    gain = np.where(fits & (gain > 1e-9 * whole), gain, -1.0).reshape(len(total), -1)
    best = gain.argmax(1)
    split = gain[np.arange(len(total)), best] > 0
    f, c, right = np.unravel_index(best, left_s.shape[1:])
    pick = lambda x: x.reshape(len(total), -1)[np.arange(len(total)), best]
    left_s, left_n = np.where(split, pick(left_s), total), np.where(split, pick(left_n), n)
    return (np.where(split, f, 0).astype(np.int16), np.where(split, c + 1, NO_SPLIT).astype(np.uint8), split & (right == 1),
            (left_s, total - left_s), (left_n, n - left_n))


def _packed(features: Sequence[str], targets: int, edges: Sequence[Sequence[float]], start: np.ndarray):
    """Rows ``(held_out, key, features..., labels...)`` to blocks."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            columns = [c.to_numpy() for c in table.columns]
            n = len(table)
            values = columns[2:2 + len(features)]
            bins = np.array([binned(v, e) for v, e in zip(values, edges, strict=True)], np.uint8).reshape(len(features), n)
            labels = np.array(columns[2 + len(features):], np.float64).reshape(targets, n)
            parts = (bins, columns[0].astype(bool), columns[1].astype(np.int64), labels - start[:, None])
            return pa.record_batch([pa.array([uuid.uuid4().hex]), pa.array([n], pa.int64()), *(
                pa.array([p.tobytes()], pa.binary()) for p in parts)], [c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                held.append(batch.slice(at, BLOCK_ROWS))
                if sum(map(len, held)) >= BLOCK_ROWS:
                    yield out()
                    held.clear()
        if held:
            yield out()
    return pack


def _refreshed(job: _Pass):
    def renew(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row in rows:
            yield *row[:-1], _read(job, row)[-1].tobytes()
    return renew


def _kept(blocks: RDD) -> tuple[RDD, int]:
    """The blocks in the cache and in the shared folder, in the partitions they have, and the number of their rows."""
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    blocks.checkpoint()
    return blocks, blocks.map(lambda row: row[1]).sum()


def _dropped(spark: SparkSession, blocks: RDD) -> None:
    blocks.unpersist()
    if blocks.getCheckpointFile():
        remove_folder(spark, blocks.getCheckpointFile())


@dataclass(frozen=True)
class _Plan:
    """What all forests have in common, and per target the features it may use and the scale of its residuals."""

    targets: int
    sizes: list[int]
    allowed: np.ndarray
    scale: np.ndarray
    trees: int
    rate: float
    depth: int
    least: int
    rows_share: float
    features_share: float
    patience: int
    seed: int

    @property
    def row_bytes(self) -> int:
        """Bins, group codes, key, residual, node and what is made on the way, of a row."""
        return 2 * len(self.sizes) + 32

    def leaves(self, m: int, side_s: tuple, side_n: tuple) -> np.ndarray:
        s, n = (np.stack(x, 1).ravel() for x in (side_s, side_n))
        return self.rate * s / self.scale[m] / np.maximum(n, 1)


def _no_splits(*shape: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(shape, np.int16), np.full(shape, NO_SPLIT, np.uint8), np.zeros(shape, bool)


def _smaller(side_n: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per child whether it is the one of its parent that is counted."""
    right = side_n[1] <= side_n[0]
    return np.stack([~right, right], 1).ravel()


def _own_rows(plan: _Plan, m: int, row: tuple) -> list[tuple]:
    """Bins, keys and residuals of the training rows of a block that have the target, and of the held-out ones."""
    _, n, bins, held_out, keys, stored = row
    bins = np.frombuffer(bins, np.uint8).reshape(len(plan.sizes), n)[plan.allowed[m]]
    held_out, keys = np.frombuffer(held_out, bool), np.frombuffer(keys, np.uint64)
    residual = np.frombuffer(stored, np.float64, n, 8 * m * n)
    known = ~np.isnan(residual)
    chosen = [np.flatnonzero(known & side) for side in (~held_out, held_out)]
    return [(bins.take(rows, axis=1), keys.take(rows), residual.take(rows)) for rows in chosen]


def _forest(plan: _Plan, m: int, train: list[tuple], val: list[tuple]) -> tuple[list[tuple], list[float]]:
    """The trees of one target, and its validation losses, from all its rows."""
    own = np.flatnonzero(plan.allowed[m])
    sizes = [plan.sizes[f] for f in own]
    bins, keys, residual = _whole(train)
    codes = [_code(bins, sizes, g) for g in joined(sizes)]
    held_out, _, error = _whole(val)
    node, drawn = _at_root(len(keys), plan.depth), np.empty(len(keys), bool)
    grown: list[tuple] = []
    losses: list[float] = []
    while (tree := len(grown)) <= plan.trees:
        if tree:
            if len(error):
                losses.append(sum(error[at] @ error[at] for at in _tiles(len(error))) / len(error))
            if _stalled(losses, plan.patience) or _flat(grown) or tree == plan.trees:
                break
        wanted = _subset(plan.allowed[m], plan.features_share, plan.seed, tree)[own]
        growing = _no_splits(2 ** plan.depth - 1)
        for level in range(plan.depth):
            seen = _Histogram(sizes, wanted, 2 ** max(level - 1, 0))
            for at in _tiles(len(keys)):
                if level:
                    node[at] = descended(bins[:, at], node[at], level - 1, *growing)
                    chosen = np.flatnonzero(drawn[at] & counted.take(node[at]))
                    parent = node[at].take(chosen) >> 1
                else:
                    drawn[at] = sampled(keys[at], tree, plan.seed, plan.rows_share)
                    chosen, parent = np.flatnonzero(drawn[at]), None
                whole = np.rint(residual[at].take(chosen) * plan.scale[m])
                seen.add([c[at] for c in codes], chosen, parent, whole)
            found = seen.tables()
            if level:
                found = tuple(_children(of, counted, x) for of, x in zip(held, found, strict=True))
            held = found
            *splits, side_s, side_n = best_splits(*found, wanted, plan.least)
            for kind, part in zip(growing, splits, strict=True):
                kind[2 ** level - 1:2 ** (level + 1) - 1] = part
            counted = _smaller(side_n)
        value = plan.leaves(m, side_s, side_n)
        for at in _tiles(len(keys)):
            residual[at] -= value.take(descended(bins[:, at], node[at], plan.depth - 1, *growing))
            node[at] = 0
        for at in _tiles(len(error)):
            error[at] -= value.take(route(held_out[:, at], *growing, plan.depth))
        feature, cut, missing_right = growing
        grown.append((np.where(cut == NO_SPLIT, 0, own[feature]).astype(np.int16), cut, missing_right, value))
    return grown, losses


def _whole(pieces: list[tuple]) -> list[np.ndarray]:
    """The pieces of bins, of keys and of residuals as one array each; the pieces are let go."""
    out = []
    for axis in (1, 0, 0):
        out.append(np.concatenate([p[0] for p in pieces], axis))
        pieces[:] = [p[1:] for p in pieces]
    return out


def _grown_whole(plan: _Plan, blocks: RDD) -> tuple[list[list[tuple]], list[list[float]]]:
    """Each forest in a task of its own, which reads all blocks from where they are kept."""
    def forest(pairs: Iterator[tuple]) -> Iterator[tuple]:
        train, val = [], []
        for m, row in pairs:
            for side, rows in zip((train, val), _own_rows(plan, m, row), strict=True):
                side.append(rows)
        yield m, *_forest(plan, m, train, val)

    targets = blocks.ctx.parallelize(range(plan.targets), plan.targets)
    done = sorted(targets.cartesian(blocks.coalesce(1)).mapPartitions(forest).collect(), key=lambda x: x[0])
    return [grown for _, grown, _ in done], [losses for *_, losses in done]


def _grown_in_passes(plan: _Plan, blocks: RDD, parts: int) -> tuple[list[list[tuple]], list[list[float]]]:
    """All forests level by level, every pass over all tasks. The blocks are let go."""
    spark = SparkSession.active()
    targets, nodes = plan.targets, 2 ** plan.depth - 1
    job = _Pass(uuid.uuid4().hex, targets, plan.sizes, list(range(targets)), 0, [], 0, plan.depth, 0, _no_splits(targets, nodes),
                plan.allowed, np.ones((targets, 1), bool), plan.scale, plan.seed, plan.rows_share)
    grown: list[list[tuple]] = [[] for _ in range(targets)]
    losses: list[list[float]] = [[] for _ in range(targets)]
    try:
        while job.active and job.tree <= plan.trees:
            if len(job.trees) >= REFRESH:
                before, blocks = blocks, _kept(blocks.mapPartitions(_refreshed(job)))[0]
                _dropped(spark, before)
                job.since, job.trees = job.tree, []
            job.growing, values = _no_splits(targets, nodes), np.zeros((targets, nodes + 1))
            job.chosen = np.array([_subset(own, plan.features_share, plan.seed, job.tree) for own in plan.allowed])
            held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for job.level in range(plan.depth):
                sums, counts, loss = _gather(blocks, parts, job)
                if job.level == 0 and job.tree:
                    stay = []
                    for a, m in enumerate(job.active):
                        if loss[a, 1]:
                            losses[m].append(loss[a, 0] / loss[a, 1])
                        if not _stalled(losses[m], plan.patience) and not _flat(grown[m]):
                            stay.append(a)
                    sums, counts, job.active = sums[stay], counts[stay], [job.active[a] for a in stay]
                    if not job.active or job.tree == plan.trees:
                        break
                first = 2 ** job.level - 1
                own = slice(first, 2 * first + 1)
                counted = np.zeros((targets, 2 * (first + 1)), bool)
                for a, m in enumerate(job.active):
                    found = sums[a], counts[a]
                    if job.level:
                        found = tuple(_children(of, job.counted[m], x) for of, x in zip(held[m], found, strict=True))
                    held[m] = found
                    *splits, side_s, side_n = best_splits(*found, job.chosen[m], plan.least)
                    for whole, part in zip(job.growing, splits, strict=True):
                        whole[m, own] = part
                    counted[m] = _smaller(side_n)
                    if job.level == plan.depth - 1:
                        values[m] = plan.leaves(m, side_s, side_n)
                job.counted = counted
            else:
                job.trees.append((*job.growing, values))
                for m in job.active:
                    grown[m].append(tuple(x[m] for x in job.trees[-1]))
                job.tree += 1
                continue
            break
    finally:
        _dropped(spark, blocks)
    return grown, losses


def grow(train: DataFrame, val: DataFrame, jobs: Mapping[str, tuple[Sequence[str], str]], *, trees: int, rate: float,
         depth: int, least: int, rows_share: float, features_share: float, patience: int, seed: int) -> dict[str, Forest]:
    """A forest per job ``name -> (features, target)``. Rows without a job's target take no part in it; a job without
    any such row has no forest. Without validation rows all ``trees`` are grown."""
    spark = train.sparkSession
    names = list(jobs)
    targets = list(dict.fromkeys(t for _, t in jobs.values()))
    features = list(dict.fromkeys(f for own, _ in jobs.values() for f in own))
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    known = train.agg(F.count(F.lit(1)).alias("n"), *[F.struct(
        F.count(number(t)).alias("n"), F.avg(number(t)).alias("mean"), F.min(number(t)).alias("low"),
        F.max(number(t)).alias("high")).alias(f"t{i}") for i, t in enumerate(targets)]).first()
    names = [name for name in names if known[f"t{targets.index(jobs[name][1])}"]["n"]]
    if not names:
        return {}
    about = [known[f"t{targets.index(jobs[name][1])}"] for name in names]
    quantiles = column_quantiles(train, features, linspace_probabilities(BINS - 1))
    edges = [sorted(set(q.quantiles))[1:] if q.n else [] for q in quantiles]
    start = np.array([a["mean"] for a in about])
    spread = np.array([a["high"] - a["low"] or 1.0 for a in about])
    bits = min(36, 59 - math.ceil(math.log2(known["n"] + 1)))
    allowed = np.array([[f in jobs[name][0] for f in features] for name in names])

    key = F.xxhash64(*[F.col(c) for c in (*features, *targets)]).alias("key")
    side = lambda df, held_out: df.select(
        F.lit(held_out).alias("held_out"), key, *[number(f).alias(f"x{i}") for i, f in enumerate(features)],
        *[number(jobs[name][1]).alias(f"y{i}") for i, name in enumerate(names)])
    rows = side(train, False).unionByName(side(val, True))
    size = max(-(-known["n"] // BLOCK_ROWS), 1)
    parts = min(max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK_BLOCKS)), 2 * size)
    packed = rows.repartition(parts, "key").mapInArrow(_packed(features, len(names), edges, start), _BLOCK)
    use_checkpoints(spark)
    plan = _Plan(len(names), [len(e) + 2 for e in edges], allowed, 2.0 ** bits / (4 * spread), trees, rate, depth, least, rows_share,
                 features_share, patience, seed)
    blocks, n_rows = _kept(packed.rdd.map(tuple))
    if n_rows <= WHOLE_BLOCKS * BLOCK_ROWS and n_rows * plan.row_bytes <= WHOLE_BYTES:
        try:
            grown, losses = _grown_whole(plan, blocks)
        finally:
            _dropped(spark, blocks)
    else:
        grown, losses = _grown_in_passes(plan, blocks, parts)
    out = {}
    for m, name in enumerate(names):
        columns = [np.array(c) for c in zip(*grown[m], strict=True)]
        at = {f: i for i, f in enumerate(jobs[name][0])}
        place = np.array([at.get(f, 0) for f in features], np.int16)
        forest = Forest(list(jobs[name][0]), [edges[features.index(f)] for f in jobs[name][0]], float(start[m]), depth,
                        place[columns[0]], *columns[1:])
        out[name] = forest.leading(best_iteration(losses[m], patience)) if losses[m] else forest
    return out


def _subset(allowed: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray:
    """The features drawn for a tree."""
    own = np.flatnonzero(allowed)
    size = max(round(share * len(own)), 1)
    drawn = np.zeros_like(allowed)
    drawn[np.random.default_rng((seed, tree)).permutation(own)[:size]] = True
    return drawn


def _flat(grown: list[tuple]) -> bool:
    """Whether the last tree found nothing to split."""
    return bool(grown) and bool((grown[-1][1] == NO_SPLIT).all())


def _stalled(losses: Sequence[float], patience: int) -> bool:
    return bool(losses) and len(losses) - best_iteration(losses, patience) >= patience


def best_iteration(losses: Sequence[float], patience: int) -> int:
    """Number of trees with the lowest loss, looking no further than ``patience`` without a better one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def scores(df: DataFrame, forests: Mapping[str, Forest]) -> DataFrame:
    """``df`` with a prediction column per forest; only their features go to Python, as Arrow batches."""
    features = list(dict.fromkeys(f for forest in forests.values() for f in forest.features))
    shared = df.sparkSession.sparkContext.broadcast(dict(forests))
    fields = ", ".join(f"p{i} double" for i in range(len(forests)))

    @F.pandas_udf(fields)
    def score(values: pd.DataFrame) -> pd.DataFrame:
        columns = [values.iloc[:, i].to_numpy(np.float64) for i in range(values.shape[1])]
        out, cache = {}, {}
        for i, forest in enumerate(shared.value.values()):
            key = tuple(forest.features)
            if key not in cache:  # forests of one run share their edges
                cache[key] = [None, None]
            if cache[key][0] != forest.edges:
                cache[key] = [forest.edges, np.array([
                    binned(columns[features.index(f)], e) for f, e in zip(forest.features, forest.edges, strict=True)], np.uint8)]
            out[f"p{i}"] = forest.score(cache[key][1])
        return pd.DataFrame(out)

    inputs: Column = F.struct(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    return df.withColumn("_scores", score(inputs)).select(
        *df.columns, *[F.col("_scores")[f"p{i}"].alias(name) for i, name in enumerate(forests)])
