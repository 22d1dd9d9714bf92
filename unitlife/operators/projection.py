"""Projected trajectories, and point-in-time questions answered for many standing points at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlife.functions.life import number, slope_rul, standing_cycle, trajectory_rul, true_rul
from unitlife.operators.drift import (
    DEFAULT_BINS, _cells, expected_counts, fit_reference, histogram, psi_from_histograms, worst_feature_by,
)
from unitlife.operators.ordered import CHUNK_ROWS, fits_one_task, running
from unitlife.operators.rul import with_eol
from unitlife.schema import EOL_THRESHOLDS, PROJECTION_MARGIN, STANDING_FRACTIONS, Keys


def standing_points(df: DataFrame, fractions: Sequence[float] = STANDING_FRACTIONS,
                    keys: Keys = Keys()) -> DataFrame:
    """``unit, max_cycle, fraction, cycle`` at the given shares of each unit's observed life."""
    lengths = df.groupBy(keys.unit).agg(F.max(keys.cycle).alias("max_cycle"))
    return lengths.select(
        keys.unit, "max_cycle", F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"),
    ).withColumn(keys.cycle, standing_cycle(F.col("max_cycle"), F.col("fraction")))


def projections(features: DataFrame, slope: float | Column, horizons: Sequence[int], *,
                trajectory: Mapping[int, Column] | None = None,
                fractions: Sequence[float] = STANDING_FRACTIONS, keys: Keys = Keys(),
                margin: int = PROJECTION_MARGIN) -> DataFrame:
    """``unit, fraction, series, x, soh`` with the series ``actual``, ``baseline`` and ``model``.

    ``actual`` is the unit's whole observed curve, once (``fraction`` is NULL); the other curves run over
    ``x = standing cycle - 1 + horizon`` and stop ``margin`` cycles after the unit's last one. Standing points
    without a row or without a last observed health are left out.
    """
    points = standing_points(features, fractions, keys)
    rows = features.filter(F.col("soh_prev").isNotNull())
    standing = rows.join(points, [keys.unit, keys.cycle]).withColumn("_slope", number(slope))
    at = F.col(keys.cycle)

    def entry(series: str, x: Column, soh: Column) -> Column:
        return F.struct(F.lit(series).alias("series"), x.cast("double").alias("x"), soh.alias("soh"))

    entries = []
    for k in horizons:
        entries.append(entry("baseline", at - 1 + k, F.col("soh_prev") + F.col("_slope") * F.lit(float(k))))
        if trajectory:
            entries.append(entry("model", at - 1 + k, trajectory[k]))
    projected = standing.select(
        keys.unit, "fraction", "max_cycle", F.inline(F.array(*entries))
    ).filter(F.col("x") <= F.col("max_cycle") + margin).drop("max_cycle")
    observed = features.select(keys.unit, F.lit(None).cast("double").alias("fraction"), entry("actual", at, F.col("soh")).alias("e"))
    return observed.select(keys.unit, "fraction", "e.*").unionByName(projected)


def point_in_time(features: DataFrame, points: DataFrame, slope: float | Column, *,
                  cycles: DataFrame | None = None, trajectory: Mapping[int, Column] | None = None,
                  thresholds: Sequence[float] = EOL_THRESHOLDS, keys: Keys = Keys(),
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Answers for ``points`` (unit, cycle): observed, true and predicted remaining life.

    One row per point and threshold: ``rul_true`` NULL when censored or past, each prediction
    NULL when its curve never crosses, and the difference of each to the truth.
    """
    asked = points.select(keys.unit, keys.cycle).distinct()
    standing = features.filter(F.col("soh_prev").isNotNull()).join(
        asked, [keys.unit, keys.cycle]).withColumn("_slope", number(slope))
    rows = with_eol(standing, cycles if cycles is not None else features, thresholds, keys,
                    chunk_rows=chunk_rows)
    entries = []
    for i, t in enumerate(thresholds):
        truth = true_rul(F.col(f"_eol{i}"), F.col(keys.cycle))
        fields = [F.lit(float(t)).alias("threshold"), truth.alias("rul_true")]
        predictions = {"baseline": slope_rul(F.col("soh_prev"), F.col("_slope"), t)}
        if trajectory:
            horizons = sorted(trajectory)
            predictions["model"] = trajectory_rul(horizons, [trajectory[k] for k in horizons], t)
        for name, rul in predictions.items():
            fields += [rul.alias(f"rul_{name}"), (rul - truth).alias(f"delta_{name}")]
        entries.append(F.struct(*fields))
    return rows.select(keys.unit, keys.cycle, "soh", "soh_prev", F.inline(F.array(*entries)))


def prefix_drift(features: DataFrame, points: DataFrame, reference: DataFrame, columns: Sequence[str], *,
                 keys: Keys = Keys(), bins: int = DEFAULT_BINS, digits: int | None = None,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """PSI per (unit, cycle) of ``points`` and feature, over the unit's rows up to that cycle.

    Every row is counted once, towards the next standing point of its unit; the counts are then
    accumulated along the standing points. The work does not grow with points times history.
    """
    asked = points.select(keys.unit, keys.cycle).distinct().join(
        features.select(keys.unit, keys.cycle), [keys.unit, keys.cycle], "left_semi")
    # Walk each unit from its last cycle to its first; a mark comes just before its own row.
    rows = features.select(
        keys.unit, keys.cycle, *[c for c in columns if c not in (keys.unit, keys.cycle)],
        F.lit(None).cast("bigint").alias("_mark"), (-2 * F.col(keys.cycle).cast("bigint")).alias("_walk"))
    marks = asked.select(
        keys.unit, F.col(keys.cycle).cast("bigint").alias("_mark"),
        (-2 * F.col(keys.cycle).cast("bigint") - 1).alias("_walk"))
    walked = rows.unionByName(marks, allowMissingColumns=True)
    # A unit has no more standing points than cycles, so one check covers both scans.
    small = fits_one_task(features, [keys.unit], chunk_rows)
    nearest = running(walked, [keys.unit], "_walk", dense=True, chunk_rows=chunk_rows, small=small,
                      last_of=(F.col("_mark").isNotNull(), {"standing_cycle": F.col("_mark")}))
    counted_to = nearest.filter(F.col("_mark").isNull() & F.col("standing_cycle").isNotNull())

    fitted = fit_reference(reference, columns, bins, digits=digits)
    expected = expected_counts(reference.sparkSession, fitted, bins)
    by = [keys.unit, "standing_cycle"]
    counts = histogram(counted_to, fitted, by, bins)
    parts = ["n", *_cells(bins)]
    summed = running(counts, [keys.unit, "feature"], "standing_cycle", dense=True, chunk_rows=chunk_rows,
                     small=small, sums={f"_b_{p}": F.col(p) for p in parts})
    seen = summed.select(*by, "feature", *[(F.col(p) + F.col(f"_b_{p}")).alias(p) for p in parts])
    return psi_from_histograms(seen, expected, by, bins)


def worst_prefix_drift(drift: DataFrame, keys: Keys = Keys()) -> DataFrame:
    return worst_feature_by(drift, [keys.unit, "standing_cycle"])
