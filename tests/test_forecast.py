"""Baselines, metrics, remaining life, projections and point-in-time answers."""

import statistics

import pytest
from pyspark.sql import functions as F

from fleets import close, cycles, psi
from unitlife.functions.life import rate_psi, slope_rul, standing_cycle, trajectory_rul
from unitlife.operators import evaluate, projection, rul
from unitlife.operators.features import FEATURE_COLUMNS, add_horizon_targets, build_features
from unitlife.operators.ordered import CHUNK
from unitlife.operators.quantiles import linspace_probabilities
from unitlife.schema import HORIZON_GRID


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def line(spark, units):
    """``units`` maps a unit to (start, step, rows)."""
    return spark.createDataFrame(
        [(u, i + 1, a + s * i, a + s * (i - 1) if i else None) for u, (a, s, n) in units.items() for i in range(n)],
        "battery_id string, cycle_index int, soh double, soh_prev double")


def test_fade_slope_is_pooled_over_rows(spark):
    assert evaluate.fade_slope(line(spark, {"A": (1.0, -0.01, 8)})).first().slope == pytest.approx(-0.01)
    slope = evaluate.fade_slope(line(spark, {"A": (1.0, -0.1, 2), "B": (1.0, -0.01, 8)})).first().slope
    assert slope == pytest.approx((-0.1 - 7 * 0.01) / 8)


def test_slope_baseline(spark):
    df = line(spark, {"A": (1.0, -0.01, 8)}).filter("cycle_index = 3")
    assert df.select(evaluate.global_slope_baseline(-0.01, 5).alias("p")).first().p == pytest.approx(0.99 - 0.05)


def errors(spark, pairs, unit="U"):
    return spark.createDataFrame([("val", "m", 1, unit, y, y - p) for y, p in pairs],
                                 "split string, method string, horizon int, battery_id string, y double, e double")


@pytest.mark.parametrize("pairs,mae,rmse,r2", [
    ([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], 0.5, (1.25 / 3) ** 0.5, 1 - 1.25 / 2),
    ([(1.0, 1.5)], 0.5, 0.5, None),
    ([(1.0, 1.0), (1.0, 1.0)], 0.0, 0.0, 1.0),
    ([(1.0, 1.0), (1.0, 2.0)], 0.5, 0.5 ** 0.5, 0.0),
])
def test_metrics(spark, pairs, mae, rmse, r2):
    row = evaluate.unit_metrics(errors(spark, pairs)).first()
    assert row.n == len(pairs)
    assert close(row.mae, mae) and close(row.rmse, rmse) and close(row.r2, r2)


def test_all_methods_score_the_same_rows(spark):
    df = add_horizon_targets(line(spark, {"A": (1.0, -0.01, 8)}), (1, 3)).withColumn("split", F.lit("val"))
    metrics = evaluate.unit_metrics(evaluate.forecast_errors(df, evaluate.baselines(-0.01, (1, 3))))
    rows = {(r.method, r.horizon): r for r in metrics.collect()}
    assert {k: r.n for k, r in rows.items()} == {
        ("baseline_last_value", 1): 7, ("baseline_global_slope", 1): 7,
        ("baseline_last_value", 3): 5, ("baseline_global_slope", 3): 5}
    assert rows["baseline_global_slope", 3].mae == pytest.approx(0, abs=1e-12)
    assert rows["baseline_last_value", 3].mae == pytest.approx(0.03)


def test_tripwire_and_report_order(spark):
    metrics = spark.createDataFrame([
        ("test", "baseline_x", 1, "U", 3, 0.1, 0.1, 0.99), ("test", "model", 1, "U", 3, 0.2, 0.1, 0.96),
        ("val", "model", 10, "U", 3, 0.2, 0.1, float("nan")), ("val", "model", 1, "U", 3, 0.2, 0.1, 0.95)],
        "split string, method string, horizon int, battery_id string, n int, mae double, rmse double, r2 double")
    assert [r.method for r in evaluate.leakage_suspects(metrics).collect()] == ["model"]
    assert [(r.split, r.horizon, r.mae) for r in evaluate.metrics_view(metrics).collect()] == [
        ("val", 1, 0.2), ("val", 10, 0.2), ("test", 1, 0.1), ("test", 1, 0.2)]


def test_end_of_life(spark):
    df = spark.createDataFrame(
        [("A", i + 1, y) for i, y in enumerate([.8, .72, .69, .71])] + [("B", 1, .9), ("B", 2, .85)],
        "battery_id string, cycle_index int, soh double")
    eol = rul.eol_cycles(df, (0.70,))
    assert {r.battery_id: r.eol_cycle for r in eol.collect()} == {"A": 3, "B": None}
    assert [r.battery_id for r in rul.censored_units(eol).collect()] == ["B"]


@pytest.mark.parametrize("horizons,values,expected", [
    ((1, 6, 11), (.75, .71, .67), 7.25), ((1, 6), (.65, .60), 1.0), ((1, 6), (.80, .75), 11.0),
    ((1, 6), (.80, .80), None), ((1, 6), (.75, .80), None), ((1, 6, 11), (.8, .6, .9), 6 - 5 * 0.1 / 0.2),
    ((1, 6, 11), (.8, None, None), None),
])
def test_trajectory_crossing(spark, horizons, values, expected):
    columns = [F.lit(v).cast("double") for v in values]
    assert close(one(spark, trajectory_rul(horizons, columns, 0.70)), expected)


def test_trajectory_needs_two_points():
    with pytest.raises(ValueError, match="two horizons"):
        trajectory_rul((1,), (None,), 0.7)


@pytest.mark.parametrize("soh,slope,expected", [
    (.80, -.002, 50.0), (.69, -.002, 0.0), (.80, 0.0, None), (.69, 0.0, None), (.69, 0.1, None)])
def test_closed_form(spark, soh, slope, expected):
    assert close(one(spark, slope_rul(F.lit(soh), slope, 0.70)), expected)


def test_standing_cycle_rounds_half_to_even(spark):
    assert [one(spark, standing_cycle(F.lit(n), F.lit(0.25))) for n in (10, 6, 132)] == [2, 2, 33]


@pytest.mark.parametrize("chunk_rows", [4, 1000])
def test_points_and_summary(spark, chunk_rows):
    # A falls 0.01 a cycle from 0.9: below 0.80 at cycle 12, below 0.70 at 22. B never gets there.
    df = line(spark, {"A": (0.9005, -0.01, 25), "B": (0.95, -0.001, 40)})
    points = rul.rul_points(df, -0.02, thresholds=(0.70, 0.80), chunk_rows=chunk_rows)
    rows = points.collect()
    assert {r.battery_id for r in rows} == {"A"}
    assert sorted(r.cycle_index for r in rows if r.threshold == 0.80) == [10, 11, 12]
    assert sorted(r.cycle_index for r in rows if r.threshold == 0.70) == list(range(10, 23))
    for r in rows:
        eol = 12 if r.threshold == 0.80 else 22
        last = 0.9005 - 0.01 * (r.cycle_index - 2)
        assert r.rul_true == eol - (r.cycle_index - 1)
        assert close(r.rul_pred, 0.0 if last < r.threshold else (r.threshold - last) / -0.02)
    for limit in (1 << 20, 2):
        for row in rul.rul_summary(points, limit=limit).collect():
            own = [abs(r.rul_pred - r.rul_true) for r in rows if r.threshold == row.threshold]
            assert (row.n_points, row.n_censored_preds) == (len(own), 0)
            assert close(row.rul_median_ae_cycles, statistics.median(own))
            assert close(row.rul_mae_cycles, statistics.fmean(own)) and close(row.rul_max_ae_cycles, max(own))


def test_censored_predictions_are_counted_not_scored(spark):
    points = spark.createDataFrame(
        [("U", 0.7, "m", 5.0, None), ("U", 0.7, "m", 4.0, 6.0), ("U", 0.7, "n", 5.0, None)],
        "battery_id string, threshold double, method string, rul_true double, rul_pred double")
    for limit in (1 << 20, 1):
        rows = {r.method: r for r in rul.rul_summary(points, limit=limit).collect()}
        assert (rows["m"].n_points, rows["m"].n_censored_preds, rows["m"].rul_median_ae_cycles) == (2, 1, 2.0)
        assert (rows["n"].n_points, rows["n"].n_censored_preds, rows["n"].rul_mae_cycles) == (1, 1, None)
        assert rows["n"].rul_median_ae_cycles is None


def test_straight_trajectory_agrees_with_the_closed_form(spark):
    df = line(spark, {"A": (0.95, -0.004, 80)})
    curve = {k: evaluate.global_slope_baseline(-0.004, k) for k in HORIZON_GRID}
    points = rul.rul_points(df, -0.004, trajectory=curve, trajectory_method="line").collect()
    closed = {(r.cycle_index, r.threshold): r.rul_pred for r in points if r.method == "global_slope"}
    for r in points:
        if r.method == "line":
            assert close(r.rul_pred, max(closed[r.cycle_index, r.threshold], 1.0), 1e-7)


def test_projections(spark):
    df = line(spark, {"A": (0.95, -0.004, 40), "tiny": (0.9, -0.01, 1)})
    rows = projection.projections(df, -0.004, (1, 6, 51), trajectory={k: F.lit(0.5) for k in (1, 6, 51)}).collect()
    assert {r.battery_id for r in rows if r.series != "actual"} == {"A"}
    at = {(r.fraction, r.series, r.x): r.soh for r in rows if r.battery_id == "A"}
    assert sum(series == "actual" for _, series, _ in at) == 40
    assert close(at[None, "actual", 10.0], 0.95 - 0.036)
    assert close(at[0.25, "baseline", 15.0], 0.95 - 0.004 * 8 - 0.004 * 6) and at[0.25, "model", 15.0] == 0.5
    assert (0.25, "baseline", 60.0) in at and (0.50, "baseline", 70.0) not in at


def test_point_in_time(spark):
    df = line(spark, {"A": (0.9005, -0.01, 25), "B": (0.95, -0.001, 40)})
    asked = spark.createDataFrame([("A", 11), ("A", 11), ("A", 1), ("A", 99), ("A", 24), ("B", 20)],
                                  "battery_id string, cycle_index int")
    rows = {(r.battery_id, r.cycle_index, r.threshold): r for r in projection.point_in_time(
        df, asked, -0.01, trajectory={1: F.lit(0.9), 2: F.lit(0.6)}, chunk_rows=6).collect()}
    assert set(rows) == {(u, c, t) for u, c in (("A", 11), ("A", 24), ("B", 20)) for t in (0.7, 0.8)}
    r = rows["A", 11, 0.7]
    assert r.rul_true == 12.0 and close(r.rul_baseline, 11.05) and close(r.delta_baseline, -0.95)
    assert close(r.rul_model, 1 + 0.2 / 0.3)
    assert rows["A", 24, 0.7].rul_true is None and rows["B", 20, 0.7].rul_true is None


@pytest.mark.parametrize("chunk_rows", [5, 1000])
def test_prefix_drift(spark, chunk_rows):
    df = build_features(cycles(spark, {"U1": 40, "U2": 23, "T": 60}), dense=True)
    train, rest = df.filter("battery_id = 'T'"), df.filter("battery_id != 'T'")
    asked = spark.createDataFrame([("U1", 12), ("U1", 30), ("U1", 31), ("U2", 23), ("U2", 99)],
                                  "battery_id string, cycle_index int")
    names = [c for c in FEATURE_COLUMNS if c != "ambient_temperature"]
    drift = projection.prefix_drift(rest, asked, train, names, chunk_rows=chunk_rows)
    got = {(r.battery_id, r.standing_cycle, r.feature): r.psi for r in drift.collect()}
    assert len(got) == 4 * len(names)
    reference = train.collect()
    seen = rest.collect()
    for (unit, cycle, name), value in got.items():
        now = [r[name] for r in seen if r.battery_id == unit and r.cycle_index <= cycle and r[name] is not None]
        base = [r[name] for r in reference if r[name] is not None]
        assert close(value, psi(base, now, linspace_probabilities(10)), 1e-9), (unit, cycle, name)
    worst = {(r.battery_id, r.standing_cycle): r for r in projection.worst_prefix_drift(drift).collect()}
    for key, row in worst.items():
        assert row.psi == max(v for k, v in got.items() if k[:2] == key)


def test_eol_attaches_without_a_hot_join_key(spark):
    df = line(spark, {"A": (0.95, -0.004, 80)})
    got = rul.with_eol(df, chunk_rows=10)
    assert got.count() == 80 and got.select(CHUNK).distinct().count() == 8
    assert got.select("_eol0", "_eol1").distinct().count() == 1


def test_ratings(spark):
    assert [one(spark, rate_psi(F.lit(x))) for x in (0.05, 0.10, 0.15, 0.25, 0.30)] == [
        "stable", "moderate shift", "moderate shift", "significant shift", "significant shift"]
