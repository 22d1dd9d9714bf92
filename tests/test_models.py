import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleets import close, cycles
from unitlife.operators import models, splits
from unitlife.operators.features import FEATURE_COLUMNS, add_horizon_targets, build_features, horizon_target
from unitlife.plans import registered, runs, views
from unitlife.sources import tables

BOOSTING = {"trees": 3, "rate": 0.3, "depth": 2, "least": 2, "rows_share": 0.9, "features_share": 0.9}


def table(spark, n=300, seed=2):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b = draw.gauss(5, 2), draw.random()
        rows.append((None if draw.random() < 0.1 else a, b, 7.0, None, 0.3 * a - 2 * b + draw.gauss(0, 0.1)))
    return rows, spark.createDataFrame(rows, "a double, b double, flat double, never double, y double")


def test_ridge_equals_the_closed_form(spark):
    rows, df = table(spark)
    model = models.train_ridge(df.unionByName(df.limit(5).withColumn("y", F.lit(None).cast("double"))),
                               ["a", "b", "flat", "never"], "y")
    got = [r.p for r in models.predict(df.coalesce(1), {"p": model}).collect()]
    x = np.array([[np.nan if r[0] is None else r[0], r[1], r[2]] for r in rows])
    x[:, 0] = np.where(np.isnan(x[:, 0]), np.nanmedian(x[:, 0]), x[:, 0])
    y = np.array([r[4] for r in rows])
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(std == 0, 1, std)
    weights = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(got, y.mean() + z @ weights, atol=1e-9)


def test_imputation_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (10.0, 2.0), (20.0, 2.0), (None, 2.0)], "a double, b double")
    for limit in (1 << 20, 2):
        assert {r.feature: r.median for r in models.feature_statistics(df, ["a", "b"], limit).collect()} == {
            "a": 6.0, "b": 2.0}
    scale = {r.feature: (r["mean"], r["std"]) for r in models.feature_statistics(df, ["a", "b"]).collect()}
    assert scale["b"] == (2.0, 1.0) and close(scale["a"][1], float(np.std([1, 2, 10, 20])))


def test_best_iteration_has_patience():
    assert models.best_iteration([5, 4, 3, 3.5, 3.2, 1], 2) == 3
    assert models.best_iteration([5, 4, 3, 3.5, 3.2, 1], 3) == 6
    assert models.best_iteration([1, 1, 1], 5) == 1


@pytest.fixture(scope="module")
def fleet(spark):
    sizes = {u: 34 for u in list(splits.SPLIT_OF)[:5] + ["B0007", "B0018"]}
    return build_features(cycles(spark, sizes), dense=True).persist()


def test_grid_stops_at_the_first_thin_horizon(spark, fleet):
    df = add_horizon_targets(fleet.filter("battery_id < 'B0007'"), (1, 10, 11, 30), dense=True)
    # Two units of 34 cycles leave 2 * (35 - k) labels.
    assert models.grid_horizons(df, (1, 10, 11, 30)) == [1, 10]
    thin = df.withColumn(horizon_target(10), F.lit(None).cast("double"))
    assert models.grid_horizons(thin, (1, 10, 11)) == [1]


def test_early_stopping_and_missing_values(spark, fleet):
    df = splits.assign_splits(add_horizon_targets(fleet, (10,), dense=True))
    frames = splits.split_frames(df)
    config = models.TrainConfig(horizons=(10,), boosting=BOOSTING | {"trees": 6}, early_stopping_rounds=1)
    model = models.train_boosted(frames["train"], frames["val"], FEATURE_COLUMNS, "soh_h10", config)
    assert 1 <= model.trees <= 6
    scored = models.predict(frames["test"], {"p": model})
    assert scored.columns == [*frames["test"].columns, "p"]
    assert scored.filter("p is null or isnan(p)").isEmpty() and not scored.filter("soh_prev is null").isEmpty()
    without_val = models.train_boosted(frames["train"], frames["val"].limit(0), FEATURE_COLUMNS, "soh_h10", config)
    assert without_val.trees == 6


def test_health_run_writes_a_version_once(spark, fleet, tmp_path):
    config = models.TrainConfig(version="1", horizons=(1, 10), boosting=BOOSTING, early_stopping_rounds=1)
    metrics, suspects = runs.forecast_soh(fleet, config=config, artifact_root=str(tmp_path))
    rows = metrics.collect()
    assert {(r.split, r.battery_id) for r in rows} == {("val", "B0007"), ("test", "B0018")}
    assert {r.method for r in rows} == {"baseline_last_value", "baseline_global_slope", "ridge_autoregressive",
                                        "gbt_autoregressive", "gbt_telemetry"}
    assert len(rows) == 2 * 2 * 5
    assert {(r.split, r.horizon, r.n) for r in rows} == {(s, k, 34 - k) for s in ("val", "test") for k in (1, 10)}
    assert all(not r.method.startswith("baseline") for r in suspects.collect())
    stored = tables.read_records(spark, f"{tmp_path}/soh_v1/metrics")
    assert stored.count() == len(rows)
    again = tables.load_model(spark, f"{tmp_path}/soh_v1", "ridge_autoregressive_h1")
    assert models.predict(fleet, {"p": again}).filter("p is null").isEmpty()
    with pytest.raises(FileExistsError, match="new version"):
        tables.save_artifacts({}, config, metrics, str(tmp_path))


def test_a_run_that_fails_half_way_leaves_its_version_free(spark, tmp_path, monkeypatch):
    metrics = spark.createDataFrame([("val", "m", 1, "B0007", 3, 0.1, 0.2, 0.3)], tables.METRICS)
    config = models.TrainConfig(version="2")
    fitted = {"ridge_h1": models.Ridge(["soh_prev"], [0.9], [1.0], 0.5)}
    save = models.save_model

    def failing(*args):
        raise OSError("lost")

    monkeypatch.setattr(models, "save_model", failing)
    with pytest.raises(OSError, match="lost"):
        tables.save_artifacts(fitted, config, metrics, str(tmp_path))
    assert os.listdir(tmp_path) == []
    monkeypatch.setattr(models, "save_model", save)
    folder = tables.save_artifacts(fitted, config, metrics, str(tmp_path))
    assert tables.load_model(spark, folder, "ridge_h1") == fitted["ridge_h1"]
    assert os.listdir(tmp_path) == ["soh_v2"]


def test_life_run_and_report(spark, fleet, tmp_path):
    grid = (1, 6, 11)
    config = models.TrainConfig(horizons=grid, boosting=BOOSTING, early_stopping_rounds=1)
    points, summary, fitted, censored = runs.forecast_rul(fleet, config=config, out=str(tmp_path / "rul"))
    assert sorted(fitted) == list(grid)
    assert {r.method for r in points.select("method").distinct().collect()} == {"global_slope", "gbt_trajectory"}
    stored_points, stored_summary = tables.read_rul(spark, str(tmp_path / "rul"))
    assert stored_points.count() == points.count() > 0
    for row in stored_summary.collect():
        own = points.filter((F.col("battery_id") == row.battery_id) & (F.col("threshold") == row.threshold)
                            & (F.col("method") == row.method)).collect()
        assert row.n_points == len(own) and row.n_censored_preds == sum(r.rul_pred is None for r in own)
    again = runs.forecast_rul(fleet, config=config, models=fitted).points
    assert again.count() == points.count()

    metrics = spark.createDataFrame([("val", "m", 1, "B0007", 3, 0.1, 0.2, 0.3)], tables.METRICS)
    varying = [c for c in fleet.columns if c in FEATURE_COLUMNS]
    report = runs.report_tables(fleet, metrics, summary, fitted)
    runs.write_report(report, str(tmp_path / "report"))
    drift = spark.read.parquet(str(tmp_path / "report/drift"))
    assert {r.compared_to_train for r in drift.select("compared_to_train").distinct().collect()} == {
        "val B0007", "test B0018"}
    assert drift.count() == 2 * len(varying)
    curves = spark.read.parquet(str(tmp_path / "report/projection"))
    assert {r.series for r in curves.select("series").distinct().collect()} == {"actual", "baseline", "model"}
    assert spark.read.parquet(str(tmp_path / "report/soh")).count() == 1


def test_boosted_queries_train_by_the_defaults_and_return_errors(spark, monkeypatch):
    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("no test tables")
    monkeypatch.setattr(views, "_staged", {})
    asked, train = [], models.train_variants

    def short(rows, val, config, keys, only):
        asked.append(config)
        return train(rows, val, models.TrainConfig(horizons=config.horizons, boosting=BOOSTING | {"trees": 1}), keys, only)

    monkeypatch.setattr(models, "train_variants", short)
    errors, counts = (registered.queries()[name](spark, small).collect() for name in ("boosted_errors", "boosted_metrics"))
    assert asked == [models.TrainConfig()]  # one fit for both
    key = lambda r: (r.split, r.method, r.horizon, r.unit_id or "", r.n)
    assert sorted(map(key, errors)) == sorted(map(key, counts))
    boosted = [r for r in errors if r.method.startswith("gbt_")]
    assert {(r.method, r.horizon) for r in boosted} == {
        (m, k) for m in ("gbt_autoregressive", "gbt_telemetry") for k in models.HORIZONS}
    assert all(r.mae is not None and r.rmse is not None for r in boosted)
