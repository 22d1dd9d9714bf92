"""End-to-end runs: ingest, features, health forecasts, remaining life, report tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitlife.functions.times import file_stem
from unitlife.operators import evaluate
from unitlife.operators.drift import drift_by
from unitlife.operators.features import (
    FEATURE_COLUMNS, add_horizon_targets, build_features, horizon_target,
)
from unitlife.operators.ingest import cycles_from_entries, route_entries, skip_counts
from unitlife.operators.models import (
    Model, TrainConfig, feature_names, predict, train_grid, train_variants, trajectory_columns, with_trajectory,
)
from unitlife.operators.projection import projections
from unitlife.operators.rul import censored_units, eol_cycles, rul_points, rul_summary
from unitlife.operators.splits import EXCLUDED_UNITS, SPLIT_OF, UnitList, UnitTable, assign_splits, split_frames
from unitlife.schema import HORIZON_GRID, Keys
from unitlife.session import shared_folder
from unitlife.sources import landing, tables
from unitlife.streaming import landing_stream


class Ingested(NamedTuple):
    """``skipped`` counts each unit's entries by what became of them; ``files`` has the chosen file per unit and the
    number of its other copies."""

    cycles: DataFrame
    skipped: DataFrame
    files: DataFrame | None


class Lives(NamedTuple):
    """Remaining life: points, error summary, the fitted grid, and the held-out units that never reach a threshold."""

    points: DataFrame
    summary: DataFrame
    models: dict[int, Model]
    censored: DataFrame


def ingest(spark: SparkSession, root: str, out: str | None = None, *, pattern: str = "*.parquet",
           kind: str = "parquet", stem: Callable[[Column], Column] = file_stem) -> Ingested:
    """Raw unit files to the validated cycle table, with the counts of what was left out.

    Validation rides on the write to ``out`` (by default a new folder in the shared one), and a unit that was one nested record
    fits a task, so the files are read once.
    """
    files = landing.discover_unit_files(spark, root, pattern, stem)
    cycles, skipped = _cycle_table(spark, landing.read_unit_files(spark, root, files, kind, pattern, stem), out, small=True)
    return Ingested(cycles, skipped, files)


def ingest_entries(spark: SparkSession, path: str, out: str | None = None, *, kind: str = "parquet") -> Ingested:
    """The same from entries that landed one per row, for units of any length; there are no files to choose from."""
    cycles, skipped = _cycle_table(spark, landing.read_entries(spark, path, kind), out)
    return Ingested(cycles, skipped, None)


def ingest_landed(spark: SparkSession, landed: str, out: str | None = None, *,
                  stem: Callable[[Column], Column] = file_stem) -> Ingested:
    """The same from what ``landing_stream.land`` has stored so far; raw files are not read again."""
    entries, files = landing_stream.read_landed(spark, landed, stem)
    cycles, skipped = _cycle_table(spark, entries, out)
    return Ingested(cycles, skipped, files)


def _cycle_table(spark: SparkSession, entries: DataFrame, out: str | None,
                 small: bool | None = None) -> tuple[DataFrame, DataFrame]:
    skipped = skip_counts(route_entries(entries))
    out = out or f"{shared_folder(spark)}/cycles-{uuid.uuid4().hex}"
    tables.write_valid_cycles(cycles_from_entries(entries, small=small), out)
    return tables.read_cycles(spark, out), skipped


def features(spark: SparkSession, cycles_path: str, out: str) -> DataFrame:
    """Ingested cycle numbers are dense, so the features need one shuffle."""
    tables.write_unit_table(build_features(tables.read_cycles(spark, cycles_path), dense=True, keep_chunk=True), out)
    return tables.read_features(spark, out)


def training_columns(assigned: DataFrame, horizons: Sequence[int], keys: Keys) -> DataFrame:
    """What the fits read of the rows they train and stop on, so that nothing else is kept in the cache."""
    return assigned.filter(F.col("split").isin("train", "val")).select(
        "split", "soh", *feature_names(FEATURE_COLUMNS, keys), *[horizon_target(k) for k in horizons])


def soh_metrics(assigned: DataFrame, models: Mapping[tuple[str, int], Model],
                slope: float, horizons: Sequence[int], keys: Keys = Keys()) -> DataFrame:
    """Baselines and models on identical held-out rows, every split and unit on its own."""
    held_out = assigned.filter(F.col("split").isin("val", "test"))
    named = {f"pred_{name}_h{k}": model for (name, k), model in models.items()}
    scored = predict(held_out, named)
    predictions = evaluate.baselines(slope, horizons) | {
        (name, k): F.col(f"pred_{name}_h{k}") for name, k in models}
    return evaluate.unit_metrics(evaluate.forecast_errors(scored, predictions, keys), keys)


def forecast_soh(features_df: DataFrame, *, cohort: UnitTable = SPLIT_OF, excluded: UnitList = EXCLUDED_UNITS,
                 config: TrainConfig = TrainConfig(), artifact_root: str | None = None,
                 keys: Keys = Keys(), dense: bool = False) -> tuple[DataFrame, DataFrame]:
    """Train all variants at all horizons; returns (metrics, leakage suspects).

    ``dense`` promises cycle numbers without gaps, as the ingest writes them; targets then need
    no counting of positions.
    """
    targets = add_horizon_targets(features_df, config.horizons, keys, dense=dense)
    assigned = assign_splits(targets, cohort, excluded, keys)
    kept = training_columns(assigned, config.horizons, keys).persist()
    frames = split_frames(kept)
    try:
        slope = evaluate.fade_slope(frames["train"]).first()["slope"]
        models = train_variants(frames["train"], frames["val"], config, keys)
    finally:
        kept.unpersist()
    metrics = soh_metrics(assigned, models, slope, config.horizons, keys)
    if artifact_root is not None:
        folder = tables.save_artifacts(
            {f"{name}_h{k}": m for (name, k), m in models.items()}, config, metrics, artifact_root)
        metrics = metrics.sparkSession.read.schema(metrics.schema).json(f"{folder}/metrics")
    return metrics, evaluate.leakage_suspects(metrics)


def forecast_rul(features_df: DataFrame, *, cohort: UnitTable = SPLIT_OF, excluded: UnitList = EXCLUDED_UNITS,
                 config: TrainConfig = TrainConfig(horizons=HORIZON_GRID), out: str | None = None,
                 models: Mapping[int, Model] | None = None, keys: Keys = Keys(),
                 dense: bool = False) -> Lives:
    """Fit the horizon grid and predict remaining life of the held-out units.

    Pass ``models`` to reuse a fitted grid.
    """
    targets = add_horizon_targets(features_df, config.horizons, keys, dense=dense)
    assigned = assign_splits(targets, cohort, excluded, keys)
    kept = training_columns(assigned, config.horizons, keys)
    if models is None:
        kept = kept.persist()  # the slope alone needs two columns once
    frames = split_frames(kept)
    try:
        slope = evaluate.fade_slope(frames["train"]).first()["slope"]
        grid = dict(models) if models is not None else train_grid(
            frames["train"], frames["val"], config, config.horizons, keys)
    finally:
        if models is None:
            kept.unpersist()
    held_out = assigned.filter(F.col("split").isin("val", "test"))
    points = rul_points(
        with_trajectory(held_out, grid), slope, held_out, trajectory=trajectory_columns(grid), keys=keys
    ).drop("split")
    sizes = held_out.select(keys.unit)
    censored = censored_units(eol_cycles(held_out, keys=keys))
    if out is None:
        return Lives(points, rul_summary(points, keys, sized_by=sizes), grid, censored)
    written, summary = tables.write_rul(points, out, lambda p: rul_summary(p, keys, sized_by=sizes))
    return Lives(written, summary, grid, censored)


def report_tables(features_df: DataFrame, metrics: DataFrame, summary: DataFrame,
                  models: Mapping[int, Model], *, cohort: UnitTable = SPLIT_OF,
                  excluded: UnitList = EXCLUDED_UNITS, keys: Keys = Keys(),
                  digits: int | None = None) -> dict[str, DataFrame]:
    """The four report tables, ordered: ``soh``, ``rul``, ``drift`` and ``projection``. ``digits`` rounds the drift edges."""
    assigned = assign_splits(features_df, cohort, excluded, keys)
    train = assigned.filter(F.col("split") == "train")
    held_out = assigned.filter(F.col("split").isin("val", "test"))
    slope = evaluate.fade_slope(train).first()["slope"]
    compared = F.concat_ws(" ", "split", F.col(keys.unit).cast("string"))
    drift = drift_by(train, held_out.withColumn("compared_to_train", compared),
                     feature_names(FEATURE_COLUMNS, keys), ["compared_to_train"], digits=digits)
    curves = projections(
        with_trajectory(held_out, models), slope, sorted(models), trajectory=trajectory_columns(models), keys=keys)
    return {
        "soh": evaluate.metrics_view(metrics, keys),
        "rul": summary.orderBy(keys.unit, "threshold", "method"),
        "drift": drift.orderBy(F.desc("compared_to_train"), F.desc("psi"), "feature"),
        "projection": curves.orderBy(keys.unit, "fraction", "series", "x"),
    }


def write_report(report: Mapping[str, DataFrame], out: str) -> None:
    for name, table in report.items():
        table.write.mode("overwrite").parquet(f"{out}/{name}")
