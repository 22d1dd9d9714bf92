"""End of life, remaining useful life at every standing point, and its error summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlife.functions.life import number, slope_rul, trajectory_rul, true_rul
from unitlife.operators.ordered import CHUNK, CHUNK_ROWS, ensure_chunk, fits_one_task, unit_values
from unitlife.operators.quantiles import GROUP_ROWS, grouped_quantiles
from unitlife.schema import EOL_THRESHOLDS, MIN_HISTORY_CYCLES, Keys


def _first_below(threshold: float, keys: Keys) -> Column:
    return F.min(F.when(F.col("soh") < threshold, F.col(keys.cycle)))


def eol_cycles(df: DataFrame, thresholds: Sequence[float] = EOL_THRESHOLDS, keys: Keys = Keys()) -> DataFrame:
    """``unit, threshold, eol_cycle``: the first cycle strictly below; NULL if none (right-censored)."""
    wide = df.groupBy(keys.unit).agg(*[
        _first_below(t, keys).alias(f"_e{i}") for i, t in enumerate(thresholds)])
    return wide.select(keys.unit, F.inline(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_e{i}").alias("eol_cycle"))
        for i, t in enumerate(thresholds)])))


def censored_units(eol: DataFrame) -> DataFrame:
    return eol.filter(F.col("eol_cycle").isNull()).drop("eol_cycle")


def with_eol(df: DataFrame, cycles: DataFrame | None = None,
             thresholds: Sequence[float] = EOL_THRESHOLDS, keys: Keys = Keys(), *,
             chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Attach ``_eol0, _eol1, ...`` (one per threshold) to every row.

    ``cycles`` is the frame that holds each unit's whole life with ``soh``; default ``df``. A row of ``df`` outside
    of it (another chunk, another unit) keeps its place.
    """
    rows = ensure_chunk(df, keys.cycle, chunk_rows)
    whole = rows
    if cycles is not None:
        asked = rows.select(keys.unit, CHUNK).distinct()
        whole = ensure_chunk(cycles, keys.cycle, chunk_rows).select(keys.unit, keys.cycle, CHUNK, "soh").unionByName(
            asked, allowMissingColumns=True)
    eol = unit_values(whole, [keys.unit], {
        f"_eol{i}": (_first_below(t, keys), F.min) for i, t in enumerate(thresholds)})
    return rows.join(eol, [keys.unit, CHUNK])


def rul_points(features: DataFrame, slope: float | Column, cycles: DataFrame | None = None, *,
               trajectory: Mapping[int, Column] | None = None, trajectory_method: str = "gbt_trajectory",
               thresholds: Sequence[float] = EOL_THRESHOLDS, keys: Keys = Keys(),
               min_history: int = MIN_HISTORY_CYCLES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Predicted and true remaining life at every standing point, per threshold and method.

    A standing point needs ``min_history`` cycles, a last observed health, and an end of life that
    lies ahead. ``slope`` is a number or a column (a scalar subquery stays lazy). ``trajectory`` maps horizons to predicted-health columns of ``features``.
    """
    standing = features.filter(
        (F.col(keys.cycle) >= min_history) & F.col("soh_prev").isNotNull()
    ).withColumn("_slope", number(slope))
    rows = with_eol(standing, cycles if cycles is not None else features, thresholds, keys,
                    chunk_rows=chunk_rows)
    entries = []
    for i, t in enumerate(thresholds):
        predictions = {"global_slope": slope_rul(F.col("soh_prev"), F.col("_slope"), t)}
        if trajectory:
            horizons = sorted(trajectory)
            predictions[trajectory_method] = trajectory_rul(horizons, [trajectory[k] for k in horizons], t)
        for method, prediction in predictions.items():
            entries.append(F.struct(
                F.lit(method).alias("method"), F.lit(float(t)).alias("threshold"),
                true_rul(F.col(f"_eol{i}"), F.col(keys.cycle)).alias("rul_true"),
                prediction.alias("rul_pred")))
    carried = ["split"] if "split" in features.columns else []
    return rows.select(
        keys.unit, keys.cycle, *carried, F.inline(F.array(*entries))
    ).filter(F.col("rul_true").isNotNull())


def rul_summary(points: DataFrame, keys: Keys = Keys(), *, sized_by: DataFrame | None = None,
                limit: int = GROUP_ROWS) -> DataFrame:
    """Error in cycles per unit, threshold and method; censored predictions are counted, not scored.

    The median is exact. It is part of the one aggregate as long as no unit has more than
    ``limit`` rows in ``sized_by`` (any cheap frame with at least one row per standing point,
    by default the points); larger groups go through ``grouped_quantiles``.
    """
    by = [keys.unit, "threshold", "method"]
    error = F.abs(F.col("rul_pred") - F.col("rul_true"))
    scored = points.withColumn("_ae", error)
    counts = [
        F.count("*").alias("n_points"), F.count_if(F.col("rul_pred").isNull()).alias("n_censored_preds"),
        F.avg("_ae").alias("rul_mae_cycles"),
    ]
    worst = F.max("_ae").alias("rul_max_ae_cycles")
    sizes = points.select(*by) if sized_by is None else sized_by
    size_keys = by if sized_by is None else [keys.unit]
    if fits_one_task(sizes, size_keys, limit):
        return scored.groupBy(*by).agg(*counts, F.median("_ae").alias("rul_median_ae_cycles"), worst)
    medians = grouped_quantiles(scored, by, "_ae", [0.5], limit=limit).select(
        *by, F.col("quantiles")[0].alias("rul_median_ae_cycles"))
    summary = scored.groupBy(*by).agg(*counts, worst)
    return summary.join(medians, by, "left").select(
        *by, "n_points", "n_censored_preds", "rul_mae_cycles", "rul_median_ae_cycles", "rul_max_ae_cycles")
