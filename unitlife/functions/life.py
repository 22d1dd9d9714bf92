"""Remaining-life arithmetic, drift ratings and standing points as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PSI_MODERATE = 0.10
PSI_SIGNIFICANT = 0.25
PROPORTION_FLOOR = 1e-4


def number(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def slope_rul(last_soh: Column, slope: float | Column, threshold: float | Column) -> Column:
    """Cycles until a constant fade reaches the threshold.

    NULL (censored) for a slope that does not fall, which is tested before anything else; 0 when
    already below the threshold.
    """
    slope, threshold = number(slope), number(threshold)
    return (
        F.when(slope >= 0, F.lit(None).cast("double"))
        .when(last_soh < threshold, F.lit(0.0))
        .otherwise((threshold - last_soh) / slope)
    )


def trajectory_rul(horizons: Sequence[int], values: Sequence[Column],
                   threshold: float | Column) -> Column:
    """First crossing of the piecewise-linear curve through ``(horizon, value)``.

    Inside the grid the crossing is interpolated; beyond it the last segment is extended, and a
    last segment that does not fall gives NULL (censored). Plain CASE branches, one per grid
    point, so the expression stays in generated code.
    """
    if len(horizons) < 2 or len(horizons) != len(values):
        raise ValueError("a trajectory needs at least two horizons and one value for each")
    threshold = number(threshold)
    branches = F.when(values[0] < threshold, F.lit(float(horizons[0])))
    for (k0, y0), (k1, y1) in zip(zip(horizons, values), list(zip(horizons, values))[1:]):
        branches = branches.when(
            y1 < threshold, F.lit(float(k0)) + (y0 - threshold) * float(k1 - k0) / (y0 - y1))
    tail = (values[-1] - values[-2]) / float(horizons[-1] - horizons[-2])
    return branches.when(
        tail < 0, F.lit(float(horizons[-1])) + (values[-1] - threshold) / -tail)


def true_rul(eol_cycle: Column, standing_cycle: Column) -> Column:
    """Cycles from the last observed one to end of life; NULL once past it or never reached."""
    left = eol_cycle - (standing_cycle - 1)
    return F.when(left > 0, left.cast("double"))


def standing_cycle(max_cycle: Column, fraction: Column) -> Column:
    """Rounded half to even."""
    return F.bround(max_cycle * fraction).cast("bigint")


def rate_psi(psi: Column) -> Column:
    return (
        F.when(psi < PSI_MODERATE, "stable").when(psi < PSI_SIGNIFICANT, "moderate shift")
        .when(psi.isNotNull(), "significant shift")
    )


def psi_term(reference_share: Column, current_share: Column) -> Column:
    expected = F.greatest(reference_share, F.lit(PROPORTION_FLOOR))
    actual = F.greatest(current_share, F.lit(PROPORTION_FLOOR))
    return (actual - expected) * F.ln(actual / expected)
