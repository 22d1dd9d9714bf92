"""Exact grouped quantiles whose memory does not grow with the group.

``percentile`` keeps a value-to-count map of the whole group in one task. That is the right plan
for groups up to ``limit`` rows. Larger groups of a table are resolved by narrowing: a sketch gives cut points of
about equal counts, the rows between them are counted exactly (map-side combined), only the cells that hold a wanted rank are
kept, and those are split again until each holds at most ``limit`` rows or a single value; a round leaves about one row in
``NARROWING_CELLS``. The brackets of all groups are a table; nothing is collected, and no side of a join is broadcast unless
Spark finds it small.

A handful of columns needs neither that table nor a shuffle of rows: ``column_order`` counts each column's values between cut
points in every task, adds the counts up, and cuts the cells that hold a wanted rank again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitlife.session import use_checkpoints

GROUP_ROWS = 1 << 20
# For a handful of groups (features) narrowing is also faster, from about here on.
FEW_GROUPS_ROWS = 1 << 19
NARROWING_CELLS = 64
COLUMN_CELLS = 1 << 10
LISTED_ROWS = 1 << 16  # values that the last round of ``column_order`` lists


def linspace_probabilities(bins: int) -> list[float]:
    """bins + 1 evenly spaced probabilities, each ``i * (1 / bins)`` in doubles, the last exact."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def large_groups(values: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Groups of more than ``limit`` values of ``_v``, with count, least and greatest."""
    return (
        values.groupBy(*keys)
        .agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .filter(F.col("_n") > limit)
    )


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float],
                      *, limit: int = GROUP_ROWS, cells: int = NARROWING_CELLS,
                      at_most: int | None = None) -> DataFrame:
    """``keys..., n, quantiles`` with linear interpolation between order statistics.

    NULL values are ignored, and so are rows with a NULL key in a large group. ``at_most`` is a known bound on the rows of any
    group; if it is within ``limit``, the groups need not be counted first.
    """
    keys = list(keys)
    values = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    plain = lambda rows: rows.groupBy(*keys).agg(
        F.count("_v").alias("n"),
        F.percentile("_v", F.array(*[F.lit(float(p)) for p in probabilities])).alias("quantiles"))
    if at_most is not None and at_most <= limit:
        return plain(values)
    use_checkpoints(values.sparkSession)
    large = large_groups(values, keys, limit).checkpoint()
    if large.isEmpty():
        return plain(values)
    named = large.select(*keys)
    # Narrowing reads the values several times. Sums behind them may differ in their last bits from run to run, so
    # they are written once.
    fixed = values.join(named, keys, "left_semi").checkpoint()
    return plain(values.join(named, keys, "left_anti")).unionByName(
        _narrowed(fixed, keys, large_groups(fixed, keys, 0), probabilities, limit, cells))


def _positions(n: Column, probabilities: Sequence[float]) -> list[Column]:
    """Where each quantile lies among the ranks 0 to n - 1."""
    return [F.lit(float(p)) * (n - 1) for p in probabilities]


def _within(start: Column, n: Column) -> Column:
    return F.filter("_ranks", lambda r: (r >= start) & (r < start + n))


def _narrowed(values: DataFrame, keys: list[str], groups: DataFrame, probabilities: Sequence[float], limit: int,
              cells: int) -> DataFrame:
    groups = groups.checkpoint()
    ends = [f(x).cast("bigint") for x in _positions(F.col("_n"), probabilities) for f in (F.floor, F.ceil)]
    # A bracket: least and greatest value, rows of the group below it, rows in it, ranks wanted of it. Brackets of a
    # group do not overlap, so the rows below tell them apart.
    brackets = groups.select(*keys, "_lo", "_hi", F.lit(0).cast("bigint").alias("_below"), "_n",
                             F.array_distinct(F.array(*ends)).alias("_ranks"))
    found = []
    while True:
        single = F.col("_lo") == F.col("_hi")
        found.append(brackets.filter(single).select(*keys, F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_v")))
        found.append(_ranked(values, keys, brackets.filter(~single & (F.col("_n") <= limit))))
        wide = brackets.filter(~single & (F.col("_n") > limit))
        if wide.isEmpty():
            break
        brackets = _split(values, keys, wide, cells).checkpoint()
    at = reduce(DataFrame.union, found).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))  # two ranks a probability at most
    quantiles = []
    for x in _positions(F.col("_n"), probabilities):
        low, high = F.floor(x), F.ceil(x)
        a, b = F.element_at("_at", low.cast("bigint")), F.element_at("_at", high.cast("bigint"))
        quantiles.append(F.when((low == high) | (a == b), a).otherwise((high - x) * a + (x - low) * b))
    return groups.join(at, keys).select(*keys, F.col("_n").alias("n"), F.array(*quantiles).alias("quantiles"))


def _inside(values: DataFrame, keys: list[str], brackets: DataFrame) -> DataFrame:
    """Rows that lie in a bracket, with the bracket's bounds and the rows below it."""
    bounds = brackets.select(*keys, "_lo", "_hi", "_below")
    return values.join(bounds, keys).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def _started(counted: DataFrame, keys: list[str], by: str, brackets: DataFrame) -> DataFrame:
    """Counts of a bracket's parts with the rank at which each starts and the ranks wanted of it; parts without are left out."""
    order = Window.partitionBy(*keys, "_below").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    started = counted.withColumn("_start", F.col("_below") + F.coalesce(F.sum("_n").over(order), F.lit(0)))
    return (
        started.join(brackets.select(*keys, "_below", "_ranks"), [*keys, "_below"])
        .withColumn("_ranks", _within(F.col("_start"), F.col("_n"))).filter(F.size("_ranks") > 0)
    )


def _split(values: DataFrame, keys: list[str], brackets: DataFrame, cells: int) -> DataFrame:
    inside = _inside(values, keys, brackets)
    share = F.array(*[F.lit(p) for p in linspace_probabilities(cells)[1:-1]])
    cuts = inside.groupBy(*keys, "_below").agg(F.array_distinct(F.approx_percentile("_v", share, 16 * cells)).alias("_cuts"))
    # The outermost values get cells of their own, so every split makes progress.
    cell = (F.when(F.col("_v") == F.col("_lo"), -1).when(F.col("_v") == F.col("_hi"), cells)
            .otherwise(F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))))
    counted = inside.join(cuts, [*keys, "_below"]).groupBy(*keys, "_below", cell.alias("_cell")).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    return _started(counted, keys, "_cell", brackets).select(
        *keys, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), F.col("_start").alias("_below"), "_n", "_ranks")


def _ranked(values: DataFrame, keys: list[str], brackets: DataFrame) -> DataFrame:
    counted = _inside(values, keys, brackets).groupBy(*keys, "_below", "_v").agg(F.count("*").alias("_n"))
    return _started(counted, keys, "_v", brackets).select(*keys, F.explode("_ranks").alias("_rank"), "_v")


def _ordered(x: float) -> int:
    """A whole number per double, in the same order; its own inverse but for the type (``_double``)."""
    bits = int(np.float64(x).view(np.int64))
    return bits if bits >= 0 else bits ^ 0x7FFFFFFFFFFFFFFF


def _double(number: int) -> float:
    return float(np.int64(number if number >= 0 else number ^ 0x7FFFFFFFFFFFFFFF).view(np.float64))


def _cut(low: float, high: float, cells: int, even: bool) -> list[float]:
    """Points between two values: evenly spaced, or evenly spaced among the doubles, which ends any distribution."""
    if even and np.isfinite(high - low):
        points = np.linspace(low, high, cells + 1)[1:-1]
    else:
        a, b = _ordered(low), _ordered(high)
        points = np.array([_double(a + (b - a) * k // cells) for k in range(1, cells)])
    return [x for x in points.tolist() if low < x < high]


def _columns(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for i in range(width):
        yield i, batch.column(i).fill_null(np.nan).to_numpy(zero_copy_only=False)


def _masks(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    found = [m.fill_null(False).to_numpy(zero_copy_only=False) for m in batch.columns[width:]]
    return found or [np.ones(len(batch), bool)]


def _counted(cuts: Sequence[np.ndarray], wanted: Sequence[np.ndarray | None], groups: int):
    """Values of each column and group at a cut point (odd codes) or between two (even ones), where ``wanted`` says so."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((groups, 2 * len(c) + 1), np.int64) for c in cuts]
        for batch in batches:
            masks = _masks(batch, len(cuts))
            for i, x in _columns(batch, len(cuts)):
                if wanted[i] is None:
                    continue
                code, known = _codes(x, cuts[i], wanted[i])
                for j, mask in enumerate(masks):
                    sums[i][j] += np.bincount(code[mask[known]], minlength=sums[i].shape[1])
        for i, own in enumerate(sums):
            j, code = np.nonzero(own)
            yield pa.record_batch([pa.array(np.full(len(j), i), pa.int32()), pa.array(j, pa.int32()), pa.array(code, pa.int32()),
                                   pa.array(own[j, code])], ["i", "j", "code", "n"])
    return count


def _codes(x: np.ndarray, cuts: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the known values whose code is wanted, and their places."""
    place = np.flatnonzero(~np.isnan(x))
    x = x[place]
    left = np.searchsorted(cuts, x)
    code = 2 * left + (cuts[np.minimum(left, len(cuts) - 1)] == x)
    inside = wanted[code]
    return code[inside], place[inside]


def _listed(cuts: Sequence[np.ndarray], wanted: Sequence[np.ndarray], groups: int):
    """The values themselves, where ``wanted``: per column, a row of marks per group."""
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = _masks(batch, len(cuts))
            for i, x in _columns(batch, len(cuts)):
                if not wanted[i].any():
                    continue
                code, place = _codes(x, cuts[i], wanted[i].any(0))
                for j, mask in enumerate(masks):
                    x_j = x[place[mask[place] & wanted[i][j][code]]]
                    if len(x_j):
                        yield pa.record_batch([pa.array(np.full(len(x_j), i), pa.int32()), pa.array(np.full(len(x_j), j), pa.int32()),
                                               pa.array(x_j)], ["i", "j", "x"])
    return values


def column_order(df: DataFrame, values: Sequence[str], bounds: Sequence[tuple[float, float] | None],
                 ranks: Callable[[int], Sequence[int]], masks: Sequence[str] = (), *, listed: int = LISTED_ROWS,
                 cells: int = COLUMN_CELLS) -> dict[tuple[int, int], tuple[int, Mapping[int, float]]]:
    """``(column, mask) -> (n, rank -> value)``: order statistics of double columns over the rows where each mask holds
    (all rows, without masks), as local values. ``bounds`` has the least and greatest value of each column (None: it has no value);
    ``ranks`` gives the ranks, from 0, that are wanted of ``n`` values.

    Every round reads the columns once and shuffles counts alone: tasks count the values between cut points, and cells
    that hold a wanted rank are cut again, until they hold ``listed`` rows in all, whose values are listed. Rounds cut by value and among
    the doubles in turn, so there are few whatever the distribution. Ties at a cut point are counted by themselves.
    """
    groups = max(len(masks), 1)
    rows = df.select(*values, *masks)
    cuts = [np.array(sorted({b[0], *_cut(*b, cells, True), b[1]}) if b else [0.0]) for b in bounds]
    # open cells by column: (below, above) -> {mask: (values of the mask below the cell, ranks)}; all of them at first
    wanted = [np.ones(2 * len(c) + 1, bool) if b else None for c, b in zip(cuts, bounds, strict=True)]
    open_cells: list[dict] = [{(-1, len(c)): {j: None for j in range(groups)}} if b else {} for c, b in zip(cuts, bounds, strict=True)]
    found: dict[tuple[int, int], tuple[int, dict[int, float]]] = {
        (i, j): (0, {}) for i in range(len(values)) for j in range(groups)}
    even = False
    while True:
        counts = [np.zeros((groups, 2 * len(c) + 1), np.int64) for c in cuts]
        summed = rows.mapInArrow(_counted(cuts, wanted, groups), "i int, j int, code int, n bigint").groupBy(
            "i", "j", "code").agg(F.sum("n").alias("n")).toArrow()
        i, j, code, n = (summed[c].to_numpy() for c in ("i", "j", "code", "n"))
        for column in range(len(values)):
            own = i == column
            counts[column][j[own], code[own]] = n[own]
        left: list[dict] = [{} for _ in cuts]
        held = 0
        for column, cell_groups in enumerate(open_cells):
            for (a, b), groups_of in cell_groups.items():
                part = slice(2 * a + 2, 2 * b + 1)
                for group, before in groups_of.items():
                    inside = counts[column][group, part]
                    ends = np.cumsum(inside)
                    if before is None:  # the first round counts all
                        before = 0, list(ranks(int(ends[-1]))) if ends[-1] else []
                        found[column, group] = int(ends[-1]), {}
                    below, asked = before
                    for rank in asked:
                        at = int(np.searchsorted(ends, rank - below, "right"))
                        place = part.start + at
                        if place % 2:
                            found[column, group][1][rank] = float(cuts[column][place // 2])
                            continue
                        cell = left[column].setdefault((place // 2 - 1, place // 2), {})
                        if group not in cell:
                            cell[group] = below + int(ends[at] - inside[at]), []
                            held += int(inside[at])
                        cell[group][1].append(rank)
        if not held:
            return found
        if held <= listed:
            break
        cuts, wanted, open_cells = _cut_again(cuts, left, cells, even)
        even = not even
    marks = [np.zeros((groups, 2 * len(c) + 1), bool) for c in cuts]
    for column, cell_groups in enumerate(left):
        for (_, b), groups_of in cell_groups.items():
            marks[column][list(groups_of), 2 * b] = True
    listing = rows.mapInArrow(_listed(cuts, marks, groups), "i int, j int, x double").toArrow()
    i, j, x = (listing[c].to_numpy() for c in ("i", "j", "x"))
    for column, cell_groups in enumerate(left):
        for (a, b), groups_of in cell_groups.items():
            for group, (below, asked) in groups_of.items():
                own = x[(i == column) & (j == group)]
                own = np.sort(own[(own > cuts[column][a]) & (own < cuts[column][b])])
                found[column, group][1].update({rank: float(own[rank - below]) for rank in asked})
    return found


def _cut_again(cuts: Sequence[np.ndarray], left: Sequence[dict], cells: int, even: bool):
    """Cut points of the next round, what it counts, and the open cells by their new places."""
    new, wanted, open_cells = [], [], []
    for own, cell_groups in zip(cuts, left, strict=True):
        share = max(cells // max(len(cell_groups), 1), 8)
        points = sorted({x for a, b in cell_groups for x in (own[a], own[b], *_cut(own[a], own[b], share, even))}) or [0.0]
        at = {x: k for k, x in enumerate(points)}
        moved = {(at[own[a]], at[own[b]]): groups for (a, b), groups in cell_groups.items()}
        mark = np.zeros(2 * len(points) + 1, bool)
        for a, b in moved:
            mark[2 * a + 2:2 * b + 1] = True
        new.append(np.array(points, np.float64))
        wanted.append(mark if moved else None)
        open_cells.append(moved)
    return new, wanted, open_cells


def column_ranks(probabilities: Sequence[float]) -> Callable[[int], list[int]]:
    """The ranks next to each quantile of ``n`` values."""
    return lambda n: sorted({int(f(p * (n - 1))) for p in probabilities for f in (np.floor, np.ceil)})


def interpolated(n: int, at: Mapping[int, float], probabilities: Sequence[float]) -> list[float] | None:
    """Quantiles by linear interpolation between the order statistics ``at``; None without values."""
    out = []
    for p in probabilities if n else ():
        x = p * (n - 1)
        low, high = int(np.floor(x)), int(np.ceil(x))
        a, b = at[low], at[high]
        out.append(a if low == high or a == b else (high - x) * a + (x - low) * b)
    return out or None
