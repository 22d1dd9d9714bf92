"""Baselines and per-unit forecast metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlife.functions.life import number
from unitlife.operators.features import horizon_target
from unitlife.schema import R2_TRIPWIRE, Keys, null_if_nan


def fade_slope(train: DataFrame) -> DataFrame:
    """One row, ``slope``: the mean of all first differences of health, pooled over units.

    ``soh_prev`` already holds each row's predecessor, so this is a plain two-phase average.
    """
    return train.agg(F.avg(F.col("soh") - F.col("soh_prev")).alias("slope"))


def last_value_baseline() -> Column:
    return F.col("soh_prev")


def global_slope_baseline(slope: float | Column, k: int) -> Column:
    return F.col("soh_prev") + number(slope) * F.lit(float(k))


def baselines(slope: float | Column, horizons: Sequence[int]) -> dict[tuple[str, int], Column]:
    out: dict[tuple[str, int], Column] = {}
    for k in horizons:
        out["baseline_last_value", k] = last_value_baseline()
        out["baseline_global_slope", k] = global_slope_baseline(slope, k)
    return out


def forecast_errors(df: DataFrame, predictions: Mapping[tuple[str, int], Column],
                    keys: Keys = Keys()) -> DataFrame:
    """Long form ``split, method, horizon, unit, y, e`` of evaluable rows.

    A row counts for a horizon if the last value and the target exist, the same for all methods.
    """
    entries = []
    for (method, k), prediction in predictions.items():
        target = F.col(horizon_target(k))
        entries.append(F.struct(
            F.lit(method).alias("method"), F.lit(k).cast("int").alias("horizon"),
            target.alias("y"), (target - prediction).alias("e")))
    return (
        df.filter(F.col("soh_prev").isNotNull())
        .select("split", keys.unit, F.inline(F.array(*entries)))
        .filter(F.col("y").isNotNull())
    )


def unit_metrics(errors: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """n, MAE, RMSE and R2 per split, method, horizon and unit; one two-phase aggregate.

    R2 is NULL under two rows; for a constant target it is 1 if the errors are all zero, else 0.
    """
    squares = F.sum(F.col("e") * F.col("e"))
    spread = F.var_pop("y") * F.count("*")
    constant = F.min("y") == F.max("y")
    r2 = (
        F.when(F.count("*") < 2, F.lit(None).cast("double"))
        .when(constant, F.when(squares == 0, 1.0).otherwise(0.0))
        .otherwise(1 - squares / spread)
    )
    return errors.groupBy("split", "method", "horizon", keys.unit).agg(
        F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), r2.alias("r2"))


def leakage_suspects(metrics: DataFrame, limit: float = R2_TRIPWIRE, exempt: str = "baseline") -> DataFrame:
    """Model rows whose R2 on unseen units is too good; methods starting with ``exempt`` are not models."""
    return metrics.filter((null_if_nan(F.col("r2")) > limit) & ~F.col("method").startswith(exempt))


def metrics_view(metrics: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Report order: split descending, then horizon, best first; ties by unit and method."""
    return metrics.select("split", keys.unit, "horizon", "method", "mae", "rmse").orderBy(
        F.desc("split"), "horizon", "mae", keys.unit, "method")
