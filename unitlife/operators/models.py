"""Forecast models per horizon: ridges from sufficient statistics, boosted trees from shared passes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitlife.operators import boosting
from unitlife.operators.boosting import Forest, best_iteration
from unitlife.operators.drift import column_quantiles
from unitlife.operators.features import FEATURE_COLUMNS, TELEMETRY_FEATURES, fit_rows, horizon_target
from unitlife.operators.quantiles import FEW_GROUPS_ROWS, column_order, column_ranks, interpolated
from unitlife.schema import HORIZON_GRID, HORIZONS, MIN_GRID_ROWS, Keys, null_if_nan
from unitlife.session import folder_exists

__all__ = ["Forest", "Ridge", "TrainConfig", "best_iteration"]

RIDGE_ALPHA = 1.0


@dataclass(frozen=True)
class TrainConfig:
    version: str = "0.3.0"
    seed: int = 42
    horizons: tuple[int, ...] = HORIZONS
    # 16 leaves at most, rows and columns sampled at 90 percent.
    boosting: Mapping[str, float] = field(default_factory=lambda: {
        "trees": 500, "rate": 0.03, "depth": 4, "least": 20, "rows_share": 0.9, "features_share": 0.9})
    early_stopping_rounds: int = 50


def feature_names(features: Sequence[str], keys: Keys) -> list[str]:
    return [keys.cycle if f == "cycle_index" else f for f in features]


def variants(keys: Keys = Keys()) -> dict[str, list[str]]:
    return {
        "ridge_autoregressive": feature_names(FEATURE_COLUMNS, keys),
        "gbt_autoregressive": feature_names(FEATURE_COLUMNS, keys),
        "gbt_telemetry": feature_names(TELEMETRY_FEATURES, keys),
    }


def feature_statistics(train: DataFrame, features: Sequence[str], limit: int = FEW_GROUPS_ROWS,
                       at_most: int | None = None) -> DataFrame:
    """``feature, n, median, mean, std`` over the present values, exact at any size: local rows, one per feature. The
    deviation is the population's, 1 where it is zero. ``at_most`` is a known bound on the rows."""
    rows = column_quantiles(train, features, [0.5], limit, also=(F.avg, F.stddev_pop), at_most=at_most)
    return train.sparkSession.createDataFrame(
        [(r.feature, r.n, r.quantiles[0] if r.n else None, r.also[0], 1.0 if r.also[1] == 0 else r.also[1]) for r in rows],
        "feature string, n bigint, median double, mean double, std double")


@dataclass(frozen=True)
class Ridge:
    """``intercept + sum of weight * (x - median)``, a missing value counting as the median."""

    features: list[str]
    medians: list[float]
    weights: list[float]
    intercept: float

    def prediction(self) -> Column:
        terms = [F.coalesce(null_if_nan(F.col(f).cast("double")) - F.lit(m), F.lit(0.0)) * F.lit(w)
                 for f, m, w in zip(self.features, self.medians, self.weights, strict=True)]
        return reduce(lambda a, b: a + b, terms, F.lit(self.intercept))

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.features, self.medians, self.weights, self.intercept)
        spark.createDataFrame([row], RIDGE).coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ridge:
        return cls(*spark.read.schema(RIDGE).parquet(path).first())


RIDGE = "features array<string>, medians array<double>, weights array<double>, intercept double"

Model = Ridge | Forest


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    model.save(spark, f"{path}/{type(model).__name__.lower()}")


def load_model(spark: SparkSession, path: str) -> Model:
    kind = Ridge if folder_exists(spark, f"{path}/ridge") else Forest
    return kind.load(spark, f"{path}/{kind.__name__.lower()}")


def train_ridges(train: DataFrame, features: Sequence[str], targets: Sequence[str],
                 alpha: float = RIDGE_ALPHA) -> dict[str, Ridge]:
    """Median-impute, scale and fit a ridge of strength ``alpha`` for every target that has rows, from sufficient statistics.

    The medians of a target's own rows come first: narrowed in passes over the features that count for all targets at once.
    One map-side combined pass then adds up moments and cross products of all targets, with every value taken relative to its
    median, so that a missing one adds nothing; each model is a solve of as many equations as features. The columns are kept while they are read.
    """
    number = lambda c: null_if_nan(F.col(c).cast("double"))
    kept = train.select(*[number(f).alias(f"x{i}") for i, f in enumerate(features)],
                        *[number(t).alias(f"y{k}") for k, t in enumerate(targets)]).persist()
    try:
        return _fitted_ridges(kept, features, targets, alpha)
    finally:
        kept.unpersist()


def _fitted_ridges(train: DataFrame, features: Sequence[str], targets: Sequence[str], alpha: float) -> dict[str, Ridge]:
    value, label = [f"x{i}" for i in range(len(features))], [f"y{k}" for k in range(len(targets))]
    ends = train.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in value]).first()
    masked = train.select(*value, *[F.col(c).isNotNull().alias(c) for c in label])
    order = column_order(masked, value, [tuple(e) if e[0] is not None else None for e in ends], column_ranks([0.5]), label)
    middles = [(interpolated(*order[i, k], [0.5]) or [None])[0] for k in range(len(targets)) for i in range(len(features))]
    width = len(features)
    medians = [middles[k * width:(k + 1) * width] for k in range(len(targets))]
    table = F.array(*[F.array(*[F.lit(m).cast("double") for m in own]) for own in medians])
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("y")) for k, c in enumerate(label)])
    long = train.select(*value, F.inline(entries)).filter("y is not null")
    centred = long.select("k", "y", *[F.coalesce(F.col(f"x{i}") - F.get(F.get(table, F.col("k")), F.lit(i)), F.lit(0.0)).alias(f"z{i}")
                                      for i in range(width)])
    z = [F.col(f"z{i}") for i in range(width)]
    sums = centred.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"),
        *[F.sum(z[i]).alias(f"s{i}") for i in range(width)], *[F.sum(z[i] * F.col("y")).alias(f"sy{i}") for i in range(width)],
        *[F.sum(z[i] * z[j]).alias(f"s{i}_{j}") for i in range(width) for j in range(i, width)])
    return {targets[r["k"]]: _solved(r, features, medians[r["k"]], alpha) for r in sums.collect()}


def _solved(r, features: Sequence[str], medians: Sequence[float | None], alpha: float) -> Ridge:
    width, n = len(features), r["n"]
    mean, label = np.array([r[f"s{i}"] for i in range(width)]) / n, r["y"] / n
    products = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(width)] for i in range(width)])
    spread = products / n - np.outer(mean, mean)
    variance = np.diag(spread).copy()
    flat = variance <= 1e-12 * np.diag(products) / n
    scale = np.sqrt(np.where(flat, 1.0, variance))
    left = n * spread / np.outer(scale, scale)
    left[flat, :], left[:, flat] = 0.0, 0.0
    right = np.where(flat, 0.0, (np.array([r[f"sy{i}"] for i in range(width)]) - n * mean * label) / scale)
    weights = np.linalg.solve(left + alpha * np.eye(width), right) / scale
    seen = [i for i in range(width) if medians[i] is not None]
    return Ridge([features[i] for i in seen], [medians[i] for i in seen], [float(weights[i]) for i in seen],
                 float(label - weights @ mean))


def train_ridge(train: DataFrame, features: Sequence[str], target: str, alpha: float = RIDGE_ALPHA) -> Ridge:
    return train_ridges(train, features, [target], alpha)[target]


def train_forests(train: DataFrame, val: DataFrame, jobs: Mapping[str, tuple[Sequence[str], str]],
                  config: TrainConfig = TrainConfig()) -> dict[str, Forest]:
    """Boosted trees for every job ``name -> (features, target)``, stopped early on the held-out ``val`` units."""
    return boosting.grow(train, val, jobs, **config.boosting, patience=config.early_stopping_rounds, seed=config.seed)


def train_boosted(train: DataFrame, val: DataFrame, features: Sequence[str], target: str,
                  config: TrainConfig = TrainConfig()) -> Forest:
    return train_forests(fit_rows(train, target), fit_rows(val, target), {target: (features, target)}, config)[target]


def predict(df: DataFrame, models: Mapping[str, Model]) -> DataFrame:
    """Add one prediction column per model: ridges as expressions, all forests in one step."""
    forests = {name: m for name, m in models.items() if isinstance(m, Forest)}
    scored = boosting.scores(df, forests) if forests else df
    ridges = {name: m.prediction() for name, m in models.items() if isinstance(m, Ridge)}
    return scored.select(*df.columns, *[ridges[name].alias(name) if name in ridges else name for name in models])


def train_variants(train: DataFrame, val: DataFrame, config: TrainConfig = TrainConfig(), keys: Keys = Keys(),
                   only: Sequence[str] | None = None) -> dict[tuple[str, int], Model]:
    """One directly trained model per variant and horizon that has a label; all ridges share their passes, and all forests theirs."""
    chosen = {name: names for name, names in variants(keys).items() if only is None or name in only}
    of_target = {horizon_target(k): k for k in config.horizons}
    fitted: dict[tuple[str, int], Model] = {}
    for name in [n for n in chosen if n.startswith("ridge")]:
        fitted |= {(name, of_target[t]): m for t, m in train_ridges(train, chosen[name], list(of_target)).items()}
    jobs = {f"{name} {k}": (names, t) for name, names in chosen.items() if not name.startswith("ridge") for t, k in of_target.items()}
    if jobs:
        for job, forest in train_forests(train, val, jobs, config).items():
            name, k = job.split()
            fitted[name, int(k)] = forest
    return {(name, k): fitted[name, k] for k in config.horizons for name in chosen if (name, k) in fitted}


def grid_label_counts(train: DataFrame, grid: Sequence[int] = HORIZON_GRID,
                      minimum: int = MIN_GRID_ROWS) -> DataFrame:
    """``horizon, n_labels, in_grid``; the grid ends at the first horizon under ``minimum`` labels."""
    names = [horizon_target(k) for k in grid]
    counts = train.agg(*[F.count(t).alias(t) for t in names])
    fewest = [F.col(names[0])]
    for t in names[1:]:
        fewest.append(F.least(fewest[-1], F.col(t)))
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("horizon"), F.col(t).alias("n_labels"), (low >= minimum).alias("in_grid"))
        for k, t, low in zip(grid, names, fewest)])))


def grid_horizons(train: DataFrame, grid: Sequence[int] = HORIZON_GRID,
                  minimum: int = MIN_GRID_ROWS) -> list[int]:
    return sorted(r["horizon"] for r in grid_label_counts(train, grid, minimum).collect() if r["in_grid"])


def boosted_fit(config: TrainConfig = TrainConfig()) -> Callable:
    def fit(train, val, names, targets):
        return train_forests(train, val, {t: (names, t) for t in targets}, config)
    return fit


def ridge_fit(train: DataFrame, val: DataFrame, names: Sequence[str], targets: Sequence[str]) -> dict[str, Ridge]:
    return train_ridges(train, names, targets)


def train_grid(train: DataFrame, val: DataFrame, config: TrainConfig = TrainConfig(),
               grid: Sequence[int] = HORIZON_GRID, keys: Keys = Keys(), *,
               fit: Callable | None = None) -> dict[int, Model]:
    """A model per grid horizon; ``fit(train, val, features, targets)`` gives all at once, by default boosted ones."""
    of_target = {horizon_target(k): k for k in grid_horizons(train, grid)}
    if not of_target:
        return {}
    fitted = (fit or boosted_fit(config))(train, val, feature_names(FEATURE_COLUMNS, keys), list(of_target))
    return {of_target[t]: model for t, model in fitted.items()}


def trajectory_columns(horizons: Sequence[int], prefix: str = "traj_h") -> dict[int, Column]:
    return {k: F.col(f"{prefix}{k}") for k in horizons}


def with_trajectory(df: DataFrame, models: Mapping[int, Model], prefix: str = "traj_h") -> DataFrame:
    """Add the predicted health at every grid horizon as ``traj_h{k}``."""
    return predict(df, {f"{prefix}{k}": model for k, model in sorted(models.items())})
