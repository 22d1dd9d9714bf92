import random

import pytest
from pyspark.sql import functions as F

from fleets import close, cycle_rows, cycles, expected_features
from unitlife.operators.features import (
    FEATURE_COLUMNS, REGISTRY, TELEMETRY_FEATURES, add_horizon_targets, build_features, evaluable,
    feature_table, fit_rows, from_cycle, horizon_target, up_to,
)
from unitlife.schema import DERIVED_COLUMNS, Keys

SIZES = {"U1": 30, "U2": 12, "U3": 1}
CHECKED = ("soh", "soh_prev", "soh_roll_mean", "soh_roll_std", "fade_rate", "voltage_min_prev",
           "time_since_prev_cycle_h")


def collected(df):
    return {(r["battery_id"], r["cycle_index"]): r for r in df.collect()}


@pytest.mark.parametrize("options", [
    {"dense": True}, {"dense": False}, {"dense": True, "chunk_rows": 4}, {"dense": False, "chunk_rows": 4}])
def test_features_equal_a_plain_walk(spark, options):
    rows = cycle_rows(SIZES)
    got = collected(build_features(cycles(spark, SIZES).repartition(4), **options))
    want = expected_features(rows)
    assert set(got) == set(want)
    for key, values in want.items():
        for name in CHECKED:
            assert close(got[key][name], values[name]), (key, name)


def test_gaps_in_cycle_numbers_do_not_change_the_frames(spark):
    dense = collected(build_features(cycles(spark, SIZES)))
    gappy = collected(build_features(cycles(spark, SIZES, index=lambda i: 7 * i + 3), chunk_rows=10))
    for (unit, i), row in dense.items():
        other = gappy[unit, 7 * (i - 1) + 3]
        assert all(close(row[c], other[c]) for c in CHECKED)


def test_null_pattern_and_gap(spark):
    rows = collected(build_features(cycles(spark, {"U1": 8}), dense=True))
    first = rows["U1", 1]
    assert first.soh == first.capacity_ah / 2.0 and first.soh_prev is None
    assert first.time_since_prev_cycle_h is None and rows["U1", 2].time_since_prev_cycle_h == 6.0
    assert [rows["U1", i].soh_roll_mean is None for i in (1, 2, 3)] == [True, True, False]
    assert [rows["U1", i].soh_roll_std is None for i in (2, 3)] == [True, False]
    assert [rows["U1", i].fade_rate is None for i in (5, 6)] == [True, False]
    assert close(rows["U1", 7].soh_roll_mean, sum(rows["U1", i].soh for i in range(2, 7)) / 5)
    assert rows["U1", 3].discharge_duration_prev == rows["U1", 2].discharge_duration_s


def test_missing_health_is_skipped_by_mean_but_voids_the_slope(spark):
    df = cycles(spark, {"U1": 10}).withColumn(
        "capacity_ah", F.when(F.col("cycle_index") == 4, F.lit(float("nan"))).otherwise(F.col("capacity_ah")))
    rows = collected(build_features(df, dense=True))
    assert rows["U1", 4].soh is None and rows["U1", 5].soh_prev is None
    assert close(rows["U1", 6].soh_roll_mean, sum(rows["U1", i].soh for i in (1, 2, 3, 5)) / 4)
    assert rows["U1", 9].fade_rate is None and rows["U1", 10].fade_rate is not None


def test_features_do_not_see_the_future(spark):
    df = cycles(spark, SIZES)
    whole = collected(build_features(df, chunk_rows=6))
    seen = collected(build_features(df, as_of=15, chunk_rows=6))
    assert set(seen) == {k for k in whole if k[1] <= 15}
    for key, row in seen.items():
        assert row.asDict() == whole[key].asDict()


def test_unit_order_and_partitioning_do_not_matter(spark):
    rows = cycle_rows(SIZES)
    once = collected(build_features(spark.createDataFrame(rows, cycles(spark, {"U": 1}).schema)))
    random.Random(2).shuffle(rows)
    again = collected(build_features(spark.createDataFrame(rows, cycles(spark, {"U": 1}).schema).repartition(7)))
    assert {k: v.asDict() for k, v in once.items()} == {k: v.asDict() for k, v in again.items()}


def test_as_of_filter_reaches_the_scan_and_one_shuffle_suffices(spark, tmp_path):
    cycles(spark, SIZES).write.parquet(str(tmp_path / "cycles"))
    table = spark.read.parquet(str(tmp_path / "cycles"))
    plan = build_features(table, as_of=5, dense=True)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(cycle_index,5)" in plan
    whole = build_features(table, dense=True, horizons=(1, 10))._jdf.queryExecution().executedPlan().toString()
    assert whole.count("Exchange hashpartitioning") == 1
    narrow = build_features(table, dense=True).select("battery_id", "soh_prev")
    assert "voltage_min" not in narrow._jdf.queryExecution().executedPlan().toString()


def test_registry(spark):
    held_back = {name for name, _, flagged in REGISTRY if flagged}
    assert held_back == {"discharge_duration_s", "voltage_min", "temp_max"}
    assert not held_back & set(FEATURE_COLUMNS) and len(FEATURE_COLUMNS) == 13
    assert len(TELEMETRY_FEATURES) == 9
    rows = feature_table(spark).collect()
    assert len(rows) == 16 and all(r.justification for r in rows)
    assert [r.feature for r in rows if r.included] == FEATURE_COLUMNS


def test_missing_columns_are_named(spark):
    with pytest.raises(KeyError, match="voltage_min"):
        build_features(cycles(spark, {"U1": 2}).drop("voltage_min"))
    with pytest.raises(ValueError, match="as_of"):
        build_features(cycles(spark, {"U1": 2}), as_of=3, horizons=(1,))


def test_other_key_names(spark):
    df = cycles(spark, {"U1": 6}).withColumnsRenamed({"battery_id": "machine", "cycle_index": "step"})
    built = build_features(df, Keys("machine", "step"))
    assert set(DERIVED_COLUMNS) <= set(built.columns) and built.count() == 6


def line(spark, sizes, step=0.01):
    return spark.createDataFrame(
        [(u, i + 1, 1.0 - step * i, 1.0 - step * (i - 1) if i else None) for u, n in sizes.items() for i in range(n)],
        "battery_id string, cycle_index int, soh double, soh_prev double")


@pytest.mark.parametrize("chunk_rows", [3, 1000])
def test_horizon_targets(spark, chunk_rows):
    df = add_horizon_targets(line(spark, {"A": 8, "B": 8}), (1, 3), chunk_rows=chunk_rows)
    rows = collected(df)
    for unit in "AB":
        assert all(rows[unit, i].soh_h1 == rows[unit, i].soh for i in range(1, 9))
        assert rows[unit, 1].soh_h3 == rows[unit, 3].soh
        assert [rows[unit, i].soh_h3 is None for i in (6, 7, 8)] == [False, True, True]
    assert evaluable(df, 3).filter("battery_id = 'A'").count() == 5
    assert fit_rows(df, horizon_target(3)).count() == 12


def test_seen_and_future_share_the_standing_cycle(spark):
    df = line(spark, {"A": 8})
    assert up_to(df, 3).count() == 3 and from_cycle(df, 3).count() == 6
