"""Target and leakage-safe features of the cycle table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitlife.functions.times import hours_between
from unitlife.operators.ordered import CHUNK_ROWS, neighbours, with_ordinal
from unitlife.schema import (
    DERIVED_COLUMNS, MIN_ROLLING_OBSERVATIONS, RATED_CAPACITY_AH, ROLLING_WINDOW, SLOPE_WINDOW, Keys,
    nan_to_null, require_columns,
)

# (feature, why it is safe or why it is held back, held back)
REGISTRY: tuple[tuple[str, str, bool], ...] = (
    ("cycle_index", "position in the unit's history, fixed before the cycle starts", False),
    ("ambient_temperature", "operating condition chosen before the cycle starts", False),
    ("time_since_prev_cycle_h", "rest time, known from two start times", False),
    ("charge_duration_s", "from the charge that ends before the cycle starts", False),
    ("charge_current_end", "taper current of the charge before the cycle", False),
    ("charge_temp_max", "peak temperature of the charge before the cycle", False),
    ("soh_prev", "last measured health, one cycle back", False),
    ("soh_roll_mean", "mean health over the preceding cycles only", False),
    ("soh_roll_std", "spread of health over the preceding cycles only", False),
    ("fade_rate", "health slope over the preceding cycles only", False),
    ("discharge_duration_prev", "duration one cycle back", False),
    ("voltage_min_prev", "lowest voltage one cycle back", False),
    ("temp_max_prev", "peak temperature one cycle back", False),
    ("discharge_duration_s", "measured during the cycle; times a constant current it is the label", True),
    ("voltage_min", "measured during the cycle; the cut-off that defines the label", True),
    ("temp_max", "measured during the cycle, together with the label", True),
)

FEATURE_COLUMNS = [name for name, _, held_back in REGISTRY if not held_back]
PAST_SOH_FEATURES = ("soh_prev", "soh_roll_mean", "soh_roll_std", "fade_rate")
TELEMETRY_FEATURES = [name for name in FEATURE_COLUMNS if name not in PAST_SOH_FEATURES]
NEEDED = ("capacity_ah", "cycle_start_time", "ambient_temperature", "discharge_duration_s",
          "voltage_min", "temp_max", "charge_duration_s", "charge_current_end", "charge_temp_max")


def feature_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(name, not held_back, why) for name, why, held_back in REGISTRY],
        "feature string, included boolean, justification string")


def horizon_target(k: int) -> str:
    return f"soh_h{k}"


def _target_columns(horizons: Sequence[int]) -> dict:
    return {horizon_target(k): (lambda w, k=k: F.lead("soh", k - 1).over(w)) for k in horizons}


def _trailing_slope(window, size: int) -> Column:
    """Least-squares slope of the preceding ``size`` values against their offsets.

    The offsets are centred, so the slope is a fixed weighting of lags; NULL if one is missing.
    """
    centre = (size - 1) / 2
    scale = sum((i - centre) ** 2 for i in range(size))
    terms = [F.lag("soh", size - i).over(window) * ((i - centre) / scale) for i in range(size)]
    slope = terms[0]
    for term in terms[1:]:
        slope = slope + term
    return slope


def _feature_columns(chosen_start: str) -> dict:
    def rolling(aggregate):
        def build(window):
            frame = window.rowsBetween(-ROLLING_WINDOW, -1)
            enough = F.count("soh").over(frame) >= MIN_ROLLING_OBSERVATIONS
            return F.when(enough, aggregate("soh").over(frame))
        return build

    def lag(name):
        return lambda w: F.lag(name, 1).over(w)

    return {
        "soh_prev": lag("soh"),
        "soh_roll_mean": rolling(F.avg),
        "soh_roll_std": rolling(F.stddev_samp),
        "fade_rate": lambda w: _trailing_slope(w, SLOPE_WINDOW),
        "discharge_duration_prev": lag("discharge_duration_s"),
        "voltage_min_prev": lag("voltage_min"),
        "temp_max_prev": lag("temp_max"),
        "time_since_prev_cycle_h":
            lambda w: hours_between(F.lag(chosen_start, 1).over(w), F.col(chosen_start)),
    }


def build_features(cycles: DataFrame, keys: Keys = Keys(), *, as_of: int | Column | None = None,
                   horizons: Sequence[int] = (), dense: bool = False,
                   chunk_rows: int = CHUNK_ROWS, keep_chunk: bool = False) -> DataFrame:
    """Cycle table plus ``soh`` and the feature columns, in one shuffle.

    Features use preceding rows only, so ``as_of`` (keep cycles up to it) filters before the
    windows without changing what is kept; Catalyst cannot know that and would filter after.
    ``horizons`` adds the horizon targets in the same pass; they look ahead, so they cannot be
    combined with ``as_of``. ``dense`` promises that cycle numbers run 1, 2, 3, ... inside each
    unit, which ingested tables do; without it row positions are counted first.
    """
    if as_of is not None and horizons:
        raise ValueError("horizon targets look ahead; as_of would cut them off")
    require_columns(cycles, (keys.unit, keys.cycle, *NEEDED))
    rows = nan_to_null(cycles)
    if as_of is not None:
        rows = rows.filter(F.col(keys.cycle) <= as_of)
    rows = rows.withColumn("soh", F.col("capacity_ah") / F.lit(RATED_CAPACITY_AH))
    position = keys.cycle if dense else "_position"
    if not dense:
        rows = with_ordinal(rows, [keys.unit], keys.cycle, position, chunk_rows=chunk_rows)
    back = max(ROLLING_WINDOW, SLOPE_WINDOW)
    built = neighbours(
        rows, [keys.unit], position, before=back, after=max(horizons, default=1) - 1,
        columns=_feature_columns("cycle_start_time") | _target_columns(horizons),
        chunk_rows=chunk_rows, keep_chunk=keep_chunk)
    require_columns(built, [keys.cycle if c == "cycle_index" else c for c in FEATURE_COLUMNS]
                    + list(DERIVED_COLUMNS))
    return built.drop("_position")


def add_horizon_targets(df: DataFrame, horizons: Sequence[int], keys: Keys = Keys(), *,
                        dense: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``soh_h{k}``: health k cycles after the last observed one, so k = 1 is the row's own."""
    position = keys.cycle if dense else "_position"
    rows = df if dense else with_ordinal(df, [keys.unit], keys.cycle, position, chunk_rows=chunk_rows)
    return neighbours(
        rows, [keys.unit], position, after=max(horizons) - 1, columns=_target_columns(horizons),
        chunk_rows=chunk_rows).drop("_position")


def evaluable(df: DataFrame, k: int) -> DataFrame:
    return df.filter(F.col("soh_prev").isNotNull() & F.col(horizon_target(k)).isNotNull())


def fit_rows(df: DataFrame, target: str) -> DataFrame:
    return df.filter(F.col(target).isNotNull())


def up_to(df: DataFrame, cycle: int | Column, keys: Keys = Keys()) -> DataFrame:
    """What had been seen by ``cycle``."""
    return df.filter(F.col(keys.cycle) <= cycle)


def from_cycle(df: DataFrame, cycle: int | Column, keys: Keys = Keys()) -> DataFrame:
    """What came at or after ``cycle``; it shares that cycle with ``up_to``."""
    return df.filter(F.col(keys.cycle) >= cycle)
