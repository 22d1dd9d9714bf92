import math
import random

import pytest
from pyspark.sql import functions as F

from fleets import close, psi
from unitlife.operators import audit, drift
from unitlife.operators.drift import expected_counts, fit_reference
from unitlife.operators.quantiles import linspace_probabilities
from unitlife.streaming.drift_monitor import batch_drift, folder_sink, monitor, read_reports


def frame(spark, xs, name="x"):
    return spark.createDataFrame([(x,) for x in xs], f"{name} double")


def gauss(n, mean=0.0, seed=0):
    draw = random.Random(seed)
    return [draw.gauss(mean, 1) for _ in range(n)]


SAMPLES = {
    "same": (gauss(5000), gauss(5000)),
    "shifted": (gauss(5000), gauss(5000, 2.0)),
    "beyond": ([i / 999 for i in range(1000)], [5.0] * 500),
    "constant, same": ([3.0] * 100, [3.0] * 100),
    "constant, moved": ([3.0] * 100, [4.0] * 100),
    "two values": ([24.0] * 7368 + [43.0] * 2632, [24.0] * 50),
    "ties at the bottom": ([0.0] * 40 + [float(i) for i in range(60)], [-1.0] * 5 + [0.0] * 5 + [30.0] * 10),
    "on the edges": ([float(i) for i in range(11)], [float(i) for i in range(11)]),
}


@pytest.mark.parametrize("kind", ["shifted", "two values", "ties at the bottom"])
def test_psi_with_narrowed_edges(spark, kind):
    a, b = SAMPLES[kind]
    got = drift.psi_between(frame(spark, a), frame(spark, b), "x", limit=50).first().psi
    assert close(got, psi(a, b, linspace_probabilities(10)), 1e-9)


def test_psi_against_plain_python(spark):
    got = {k: drift.psi_between(frame(spark, a), frame(spark, b), "x").first().psi
           for k, (a, b) in SAMPLES.items()}
    for kind, (a, b) in SAMPLES.items():
        assert close(got[kind], psi(a, b, linspace_probabilities(10)), 1e-9), kind
    assert got["same"] < 0.01 and got["constant, same"] < 0.01
    assert min(got["shifted"], got["beyond"], got["constant, moved"]) > 0.25
    assert got["two values"] == pytest.approx(2.152, abs=2e-3)


@pytest.mark.parametrize("bins", [2, 3, 20])
def test_other_bin_counts(spark, bins):
    a, b = SAMPLES["shifted"]
    got = drift.psi_between(frame(spark, a), frame(spark, b), "x", bins).first().psi
    assert close(got, psi(a, b, linspace_probabilities(bins)), 1e-9)


@pytest.mark.parametrize("reference,current", [([], [1.0]), ([1.0], []), ([1.0], [None, float("nan")])])
def test_empty_sides_are_errors(spark, reference, current):
    with pytest.raises(Exception, match="non-empty"):
        drift.psi_between(frame(spark, reference), frame(spark, current), "x").collect()


def test_missing_values_are_dropped(spark):
    a, b = SAMPLES["shifted"]
    holes = [None, float("nan")] * 10
    assert close(drift.psi_between(frame(spark, a + holes), frame(spark, b + holes), "x").first().psi,
                 psi(a, b, linspace_probabilities(10)))


def test_report_is_worst_first(spark):
    reference = spark.createDataFrame(list(zip(gauss(2000), gauss(2000, seed=1))), "a double, b double")
    current = spark.createDataFrame(list(zip(gauss(2000, seed=2), gauss(2000, 3.0, seed=3))), "a double, b double")
    rows = drift.drift_report(reference, current, ["a", "b"]).collect()
    assert [(r.feature, r.rating) for r in rows] == [("b", "significant shift"), ("a", "stable")]
    assert drift.worst_feature(drift.drift_by(reference, current, ["a", "b"])).first().feature == "b"


def test_drift_per_cohort(spark):
    reference = frame(spark, gauss(500))
    near, far = gauss(300, seed=4), gauss(300, 1.5, seed=5)
    current = spark.createDataFrame([("near", x) for x in near] + [("far", x) for x in far], "cohort string, x double")
    got = {r.cohort: r.psi for r in drift.drift_by(reference, current, ["x"], ["cohort"]).collect()}
    for name, xs in (("near", near), ("far", far)):
        assert close(got[name], psi(gauss(500), xs, linspace_probabilities(10)))
    worst = drift.worst_feature_by(drift.drift_by(reference, current, ["x"], ["cohort"]), ["cohort"])
    assert worst.count() == 2
    silent = current.unionByName(spark.createDataFrame([("none", None)], "cohort string, x double"))
    report = drift.drift_by(reference, silent, ["x"], ["cohort"])
    assert {r.cohort: (r.psi, r.rating) for r in report.collect()}["none"] == (None, "no data")
    assert report.filter("cohort <> 'none'").filter("psi IS NULL").isEmpty()


def test_stream_reports_each_batch(spark, tmp_path):
    a = gauss(400)
    batches = [gauss(200, seed=8), gauss(200, 2.0, seed=9)]
    for i, xs in enumerate(batches):
        frame(spark, xs).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    stream = spark.readStream.schema("x double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    seen = {}
    query = monitor(stream, frame(spark, a), ["x"],
                    lambda report, batch: seen.update({batch: report.collect()}), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert sorted(seen) == [0, 1]
    got = sorted(rows[0].psi for rows in seen.values())
    want = sorted(psi(a, xs, linspace_probabilities(10)) for xs in batches)
    assert all(close(g, w) for g, w in zip(got, want))
    assert all(rows[0].batch_id == b for b, rows in seen.items())


def test_a_restarted_or_repeated_batch_is_reported_once(spark, tmp_path):
    reference = frame(spark, gauss(400))
    fitted = fit_reference(reference, ["x"])

    def run():
        stream = spark.readStream.schema("x double").option("recursiveFileLookup", "true").option(
            "maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        monitor(stream, reference, ["x"], folder_sink(f"{tmp_path}/reports"), str(tmp_path / "checkpoint"),
                fitted=fitted).awaitTermination()
        return sorted(read_reports(spark, f"{tmp_path}/reports").collect())

    frame(spark, gauss(300, seed=4)).repartition(5).write.parquet(f"{tmp_path}/in/a")
    first = run()
    assert [r.batch_id for r in first] == [0, 1, 2]
    assert run() == first
    frame(spark, gauss(300, 2.0, seed=5)).repartition(2).write.parquet(f"{tmp_path}/in/b")
    second = run()
    assert second[:3] == first and [r.batch_id for r in second] == [0, 1, 2, 3] and second[3].rating == "significant shift"
    again = spark.read.schema("x double").parquet(f"{tmp_path}/in/b")
    folder_sink(f"{tmp_path}/reports")(batch_drift(again, 3, fitted, expected_counts(spark, fitted, 10)), 3)
    assert sorted(read_reports(spark, f"{tmp_path}/reports").collect()) == second


def audited(spark, units):
    rows = [(u, i + 1, y, t) for u, series in units.items() for i, (y, t) in enumerate(series)]
    df = spark.createDataFrame(rows, "battery_id string, cycle_index int, soh double, ambient_temperature double")
    return df, {r.battery_id: r for r in audit.fleet_audit(df.repartition(3)).collect()}


def test_audit_flags(spark):
    clean = [(0.95, 24.0)] * 30
    _, got = audited(spark, {
        "clean": clean, "short": clean[:29],
        "just": [(1.0052, 24.0)] * 30, "above": [(1.006, 24.0)] * 30,
        "below": [(0.69, 24.0)] + clean, "zero": clean + [(0.19, 24.0)],
        "ambient": clean + [(0.9, 4.0)],
        "all": [(0.6, 4.0), (1.1, 24.0), (0.1, 43.0)],
        "gap": [(None, 24.0)] + clean,
    })
    assert {u: r.flags for u, r in got.items()} == {
        "clean": "", "short": "very short run", "just": "", "above": "SoH > 1 (impossible)",
        "below": "below EOL at first cycle", "zero": "near-zero capacity runs",
        "ambient": "ambient changes mid-experiment", "gap": "",
        "all": "SoH > 1 (impossible); below EOL at first cycle; near-zero capacity runs; "
               "ambient changes mid-experiment; very short run"}
    assert got["just"].soh_max == 1.005
    assert got["all"].n_ambients == 3
    assert (got["all"].soh_first, got["all"].soh_last, got["all"].n) == (0.6, 0.1, 3)
    assert got["gap"].soh_first == 0.95 and got["gap"].n == 31


def test_any_number_of_ambient_settings(spark):
    df = spark.range(1, 1502).select(
        F.lit("U").alias("battery_id"), F.col("id").alias("cycle_index"), F.lit(0.9).alias("soh"),
        F.col("id").cast("double").alias("ambient_temperature"))
    row = audit.fleet_audit(df).first()
    assert row.n_ambients == 1501 and row.flags == "ambient changes mid-experiment"
    assert audit.ambient_settings(df).count() == 1501


def test_runs(spark):
    df = spark.createDataFrame(
        [("A", 1, 0.19, 3.1), ("A", 2, 0.2, 2.5), ("B", 1, 0.9, 2.5), ("C", 1, 0.1, 3.0)],
        "battery_id string, cycle_index int, soh double, voltage_min double")
    runs = audit.classify_runs(df, units=["A", "B"])
    assert sorted((r.battery_id, r.cycle_index, r.run) for r in runs.collect()) == [
        ("A", 1, "aborted"), ("A", 2, "complete"), ("B", 1, "complete")]
    assert [(r.battery_id, r.n_aborted) for r in audit.aborted_runs(runs).collect()] == [("A", 1)]
    assert tuple(audit.fleet_size(df).first()) == (4, 3)
    assert tuple(audit.fleet_size(df.limit(0)).first()) == (0, 0)


def test_histogram_counts_every_bin(spark):
    draw = random.Random(6)
    rows = [(f"u{draw.randrange(3)}", None if draw.random() < 0.2 else draw.choice([draw.gauss(0, 1), 0.0, 1.0, math.nan]), draw.random(), 7.0, None)
            for _ in range(600)]
    df = spark.createDataFrame(rows, "unit string, x double, y double, same double, never double")
    names = ["x", "y", "same", "never"]
    fitted = drift.fit_edges(df.filter("unit <> 'u1'"), names)
    for by in ([], ["unit"]):
        want = set()
        for unit in {r[0] for r in rows} if by else {None}:
            for i, f in enumerate(fitted):
                xs = [r[1 + i] for r in rows if unit in (None, r[0]) and r[1 + i] is not None and not math.isnan(r[1 + i])]
                places = [sum(x >= e for e in f.edges) for x in xs]
                want.add((*([unit] if by else []), f.feature, len(xs), *(places.count(k) for k in range(10))))
        assert set(map(tuple, drift.histogram(df, fitted, by).collect())) == want
    assert [tuple(r)[1:] for r in drift.histogram(df.limit(0), fitted).collect()] == [(0,) * 11] * 4
