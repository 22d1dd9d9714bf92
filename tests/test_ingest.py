import datetime as dt

import pytest
from pyspark.sql import functions as F

from unitlife.functions.times import datevec_to_timestamp, file_stem, hours_between
from unitlife.functions.waveform import charge_summary, discharge_summary
from unitlife.operators import validate
from unitlife.operators.features import build_features
from unitlife.operators.ingest import attach_charges, cycles_from_entries, route, route_entries, skip_counts
from unitlife.operators.validate import capacity_examples, validate_cycles, validation_counts
from unitlife.plans import runs
from unitlife.schema import CHARGE_COLUMNS, CYCLES, RAW_ENTRIES, RAW_FILE, DataValidationError
from unitlife.sources import landing, tables
from unitlife.streaming import landing_stream


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_datevec(spark):
    assert one(spark, datevec_to_timestamp(vec(2008, 4, 2, 13, 8, 17.5))) == dt.datetime(2008, 4, 2, 13, 8, 17, 500000)
    assert one(spark, datevec_to_timestamp(vec(2008, 4, 2, 13, 8, 60.25))) == dt.datetime(2008, 4, 2, 13, 9, 0, 250000)
    with pytest.raises(Exception, match="6-element"):
        one(spark, datevec_to_timestamp(vec(2008, 4, 2)))


def test_hours_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        a, b = (F.lit(t).cast("timestamp_ntz") for t in ("2024-03-31 01:30:00", "2024-03-31 03:30:00.36"))
        assert one(spark, hours_between(a, b)) == pytest.approx(2.0001, abs=1e-12)
        assert one(spark, hours_between(b, a)) == pytest.approx(-2.0001, abs=1e-12)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_stem(spark):
    for path, stem in {"/a/B0005.parquet": "B0005", "x/y.tar.gz": "y.tar", "plain": "plain", "a/.hidden": ".hidden"}.items():
        assert one(spark, file_stem(F.lit(path))) == stem


ARRAYS = "data struct<voltage_measured: array<double>, current_measured: array<double>, " \
         "temperature_measured: array<double>, time: array<double>, capacity: array<double>>"


def test_waveforms(spark):
    samples = ([3.9, 3.1, 2.9, 3.3], [-1.0, -3.0, -0.5, 0.5], [11.0, 19.0, 40.0, 6.0], [5.0, 60.0, 90.0, 725.0], [1.2])
    df = spark.createDataFrame([(samples,)], ARRAYS)
    discharged = df.select(*[c.alias(n) for n, c in discharge_summary().items()]).first().asDict()
    assert discharged == pytest.approx({
        "discharge_duration_s": 725.0, "voltage_min": 2.9, "voltage_mean": 3.3, "current_mean": -1.0, "temp_max": 40.0,
        "temp_mean": 19.0})
    charged = df.select(*[c.alias(n) for n, c in charge_summary().items()]).first().asDict()
    assert charged == pytest.approx({
        "charge_duration_s": 725.0, "charge_current_end": 0.5, "charge_temp_max": 40.0, "charge_temp_mean": 19.0})


def test_waveform_edge_cases(spark):
    nan = float("nan")
    df = spark.createDataFrame([(([1.0, nan], [1.0, 2.0], [nan], [0.0, 5.0], None),)], ARRAYS)
    row = df.select(*[c.alias(n) for n, c in discharge_summary().items()]).first()
    assert row.voltage_min is None and row.voltage_mean is None and row.temp_max is None
    assert row.discharge_duration_s == 5.0
    empty = spark.createDataFrame([(([], [], [], [], None),)], ARRAYS)
    with pytest.raises(Exception, match="missing or empty"):
        empty.select(discharge_summary()["voltage_min"]).collect()


def measured(cycle=1, capacity=2.5, duration=42.0, unit="m"):
    return unit, cycle, capacity, duration


@pytest.mark.parametrize("rows,message", [
    ([measured(), measured(2), measured(unit="n")], None),
    ([], "empty"),
    ([measured(), measured(2, capacity=4.0)], "capacity outside"),
    ([measured(capacity=-0.1)], "capacity outside"),
    ([measured(capacity=0.0)], "capacity outside"),
    ([measured(capacity=3.2)], "capacity outside"),
    ([measured(capacity=3.1999)], None),
    ([measured(3), measured(4), measured(3)], "duplicate"),
    ([measured(capacity=None)], "null"),
    ([measured(capacity=float("nan")), measured(2)], "null"),
    ([measured(unit=None)], "null"),
    ([measured(duration=-1.0)], "duration"),
    ([measured(duration=0.0), measured(2)], "duration"),
    ([measured(duration=None)], None),
    ([measured(capacity=None, duration=0.0), measured(capacity=8.0)], "null"),
])
def test_validation(spark, rows, message):
    df = spark.createDataFrame(rows, "battery_id string, cycle_index int, capacity_ah double, discharge_duration_s double")
    if message is None:
        validate_cycles(df)
    else:
        with pytest.raises(DataValidationError, match=message):
            validate_cycles(df)


def test_validation_message_shows_a_few_rows(spark):
    df = spark.createDataFrame([("U", i, 9.0 + i, 1.0) for i in range(1, 9)],
                               "battery_id string, cycle_index int, capacity_ah double, discharge_duration_s double")
    assert [r.cycle_index for r in capacity_examples(df).collect()] == [1, 2, 3, 4, 5]
    assert validation_counts(df).first().n_capacity == 8


CARRY = [
    (0, "discharge", [1.9], None), (1, "charge", None, 100.0), (2, "charge", None, 200.0),
    (3, "impedance", None, None), (4, "discharge", [], None), (5, "discharge", [0.0], None),
    (6, "other", None, None), (7, "discharge", [1.8], None), (8, "discharge", [1.7], None),
]


@pytest.mark.parametrize("chunk_rows", [1, 2, 3, 1000])
def test_charge_carry(spark, chunk_rows):
    df = spark.createDataFrame(
        [(u, *row) for u in ("U1", "U2") for row in CARRY],
        "battery_id string, file_cycle_number int, type string, capacity array<double>, charge_duration_s double")
    routed = df.withColumn("route", route(F.col("type"), F.get("capacity", 0)))
    got = attach_charges(routed, charge_columns=("charge_duration_s",), chunk_rows=chunk_rows).collect()
    for unit in ("U1", "U2"):
        own = sorted((r.cycle_index, r.file_cycle_number, r.charge_duration_s) for r in got if r.battery_id == unit)
        assert own == [(1, 0, None), (2, 7, 200.0), (3, 8, None)]
    counts = skip_counts(routed).first()
    assert (counts.n_entries, counts.n_cycles, counts.n_no_capacity, counts.n_non_positive, counts.n_unknown) == (
        9, 3, 1, 1, 1)


def test_nan_capacity_is_left_to_validation(spark):
    assert one(spark, route(F.lit("discharge"), F.lit(float("nan")))) == "discharge"


def entry(kind, capacity=None, scale=1.0):
    samples = [1.0 * scale, 2.0 * scale]
    return (kind, 24.0, [2008.0, 4.0, 2.0, 13.0, 8.0, 17.5], (samples, samples, samples, samples, capacity))


FILE = [entry("charge", scale=3.0), entry("discharge", [1.9]), entry("impedance"), entry("discharge", None),
        entry("discharge", [1.8]), entry("mystery")]


def test_entries_to_cycles(spark):
    df = spark.createDataFrame([("U1", i, *e) for i, e in enumerate(FILE)], RAW_ENTRIES)
    assert [r.route for r in route_entries(df).orderBy("file_cycle_number").collect()] == [
        "charge", "discharge", "impedance", "no capacity", "discharge", "unknown type"]
    cycles = cycles_from_entries(df)
    assert cycles.columns == CYCLES.fieldNames()
    assert [f.dataType for f in cycles.schema.fields] == [f.dataType for f in CYCLES.fields]
    first, second = cycles.orderBy("cycle_index").collect()
    assert (first.file_cycle_number, first.charge_duration_s, first.charge_current_end) == (1, 6.0, 6.0)
    assert (second.file_cycle_number, second.cycle_index, second.charge_duration_s) == (4, 2, None)
    assert first.cycle_start_time == dt.datetime(2008, 4, 2, 13, 8, 17, 500000)


def test_largest_file_wins_and_ties_go_to_the_first_path(spark):
    listing = spark.createDataFrame(
        [("a/U1.x", 10), ("b/U1.x", 10), ("a/U2.x", 5), ("b/U2.x", 9), ("a-1/U3.x", 4), ("a/z/U3.x", 4)],
        "path string, length long")
    chosen = {r.stem: r for r in landing.choose_files(listing).collect()}
    assert {k: r.path for k, r in chosen.items()} == {"U1": "a/U1.x", "U2": "b/U2.x", "U3": "a/z/U3.x"}
    assert chosen["U2"].n_skipped == 1


def land(spark, root, unit, cycle, stem=None, kind="parquet", folder="raw"):
    """Write one unit as a single file named after it."""
    staging = f"{root}/staging-{folder}-{unit}-{stem}"
    getattr(spark.createDataFrame([(unit, cycle)], RAW_FILE).coalesce(1).write, kind)(staging)
    import glob
    import os
    import shutil
    part = [p for p in glob.glob(f"{staging}/part-*") if not p.endswith(".crc")][0]
    os.makedirs(f"{root}/{folder}", exist_ok=True)
    shutil.copy(part, f"{root}/{folder}/{stem or unit}.{kind}")


def test_ingest_run_and_table_round_trip(spark, tmp_path):
    root = str(tmp_path)
    land(spark, root, "U1", FILE, folder="raw/one")
    land(spark, root, "U1", FILE[:2], folder="raw/two")
    land(spark, root, "U2", FILE, folder="raw/two")
    cycles, skipped, files = runs.ingest(spark, f"{root}/raw", f"{root}/out/cycles")
    assert cycles.schema == CYCLES
    counts = {r.battery_id: r for r in skipped.collect()}
    assert set(counts) == {"U1", "U2"} and counts["U1"].n_cycles == 2 and counts["U1"].n_entries == 6
    assert {r.stem: r.n_skipped for r in files.collect()} == {"U1": 1, "U2": 0}
    assert sorted((r.battery_id, r.cycle_index) for r in cycles.collect()) == [
        ("U1", 1), ("U1", 2), ("U2", 1), ("U2", 2)]
    features = runs.features(spark, f"{root}/out/cycles", f"{root}/out/features")
    assert features.count() == 4 and len(features.columns) == 25
    plan = cycles.filter("battery_id = 'U1'").select("soh" if "soh" in cycles.columns else "capacity_ah")
    assert "EqualTo(battery_id,U1)" in plan._jdf.queryExecution().executedPlan().toString()


def test_json_landing(spark, tmp_path):
    land(spark, str(tmp_path), "U7", FILE, kind="json")
    files = landing.discover_unit_files(spark, f"{tmp_path}/raw", "*.json")
    entries = landing.read_unit_files(spark, f"{tmp_path}/raw", files, "json", "*.json")
    assert [r.file_cycle_number for r in entries.orderBy("file_cycle_number").collect()] == list(range(6))
    assert cycles_from_entries(entries).count() == 2


def test_flat_landing(spark, tmp_path):
    df = spark.createDataFrame([("U1", i, *e) for i, e in enumerate(FILE)], RAW_ENTRIES)
    df.write.parquet(str(tmp_path / "entries"))
    assert cycles_from_entries(landing.read_entries(spark, str(tmp_path / "entries"))).count() == 2
    cycles, skipped, files = runs.ingest_entries(spark, str(tmp_path / "entries"), str(tmp_path / "cycles"))
    assert cycles.count() == 2 and skipped.first().n_unknown == 1 and files is None


def test_file_must_hold_its_own_unit(spark, tmp_path):
    land(spark, str(tmp_path), "U1", FILE, stem="U9")
    files = landing.discover_unit_files(spark, f"{tmp_path}/raw")
    with pytest.raises(Exception, match="own unit: U9"):
        landing.read_unit_files(spark, f"{tmp_path}/raw", files).collect()


def test_no_files(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    with pytest.raises(FileNotFoundError):
        landing.discover_unit_files(spark, str(tmp_path / "raw"))


def test_rejected_ingest_writes_nothing(spark, tmp_path):
    land(spark, str(tmp_path), "U1", [entry("discharge", [9.0])])
    with pytest.raises(DataValidationError, match="capacity outside"):
        runs.ingest(spark, f"{tmp_path}/raw", f"{tmp_path}/cycles")
    assert not (tmp_path / "cycles").exists()


def test_records_round_trip(spark, tmp_path):
    rows = [("val", "m", 1, "U1", 3, 0.1, 0.2, None)]
    df = spark.createDataFrame(rows, tables.METRICS)
    tables.write_records(df, str(tmp_path / "metrics"))
    assert '"r2":null' in "".join(p.read_text() for p in (tmp_path / "metrics").glob("part-*"))
    assert tables.read_records(spark, str(tmp_path / "metrics")).collect() == df.collect()
    (tmp_path / "array.json").write_text('[{"split": "val", "horizon": 1, "mae": 0.5}, {"split": "test"}]')
    assert tables.read_records(spark, str(tmp_path / "array.json"), lines=False).count() == 2


def test_a_second_landing_reads_new_files_only(spark, tmp_path):
    root, out = str(tmp_path), str(tmp_path / "landed")

    def run(**options):
        landing_stream.land(spark, f"{root}/raw", out, **options).awaitTermination()
        return sorted((r.batch, r.path.split("/raw/")[1]) for r in landing_stream.landed_files(spark, out).collect())

    land(spark, root, "U1", FILE[:2], folder="raw/one")
    land(spark, root, "U2", FILE, folder="raw/one")
    assert run() == [(0, "one/U1.parquet"), (0, "one/U2.parquet")]
    before = runs.ingest_landed(spark, out).cycles.collect()
    assert sorted((r.battery_id, r.cycle_index) for r in before) == [("U1", 1), ("U2", 1), ("U2", 2)]
    assert len(run()) == 2  # nothing new, no batch
    land(spark, root, "U1", FILE, folder="raw/two")
    land(spark, root, "U2", FILE[:2], folder="raw/two")
    land(spark, root, "U3", FILE, folder="raw/two")
    landed = run(files_per_batch=1)
    assert landed[:2] == [(0, "one/U1.parquet"), (0, "one/U2.parquet")] and [b for b, _ in landed[2:]] == [1, 2, 3]
    cycles, skipped, files = runs.ingest_landed(spark, out, f"{root}/cycles")
    assert sorted((r.battery_id, r.cycle_index) for r in cycles.collect()) == [
        (u, c) for u in ("U1", "U2", "U3") for c in (1, 2)]
    assert {r.stem: (r.path.split("/raw/")[1], r.n_skipped) for r in files.collect()} == {
        "U1": ("two/U1.parquet", 1), "U2": ("one/U2.parquet", 1), "U3": ("two/U3.parquet", 0)}
    assert {r.battery_id: r.n_entries for r in skipped.collect()} == {"U1": 6, "U2": 6, "U3": 6}


def test_a_landed_file_without_entries_is_listed(spark, tmp_path):
    root, out = str(tmp_path), str(tmp_path / "landed")
    land(spark, root, "U1", FILE, folder="raw")
    land(spark, root, "U2", [], folder="raw")
    landing_stream.land(spark, f"{root}/raw", out).awaitTermination()
    assert sorted(r.path.split("/raw/")[1] for r in landing_stream.landed_files(spark, out).collect()) == ["U1.parquet", "U2.parquet"]
    entries, files = landing_stream.read_landed(spark, out)
    assert {r.battery_id for r in entries.collect()} == {"U1"} and sorted(r.stem for r in files.collect()) == ["U1", "U2"]
    assert {r.battery_id: r.n_entries for r in runs.ingest_landed(spark, out).skipped.collect()} == {"U1": 6}


FLAWS = {
    "empty": [],
    "null": [("u", 1, 2.0, 5.0), ("u", 2, None, 5.0)],
    "duplicate": [("u", 1, 2.0, 5.0), ("u", 2, 2.0, 5.0), ("u", 1, 2.1, 5.0)],
    "capacity outside": [("u", 1, 2.0, 5.0), ("v", 1, 3.2, 5.0)],
    "duration": [("u", 1, 2.0, 5.0), ("v", 1, 2.0, 0.0)],
}


@pytest.mark.parametrize("rule", FLAWS)
def test_rules_ride_on_the_write(spark, tmp_path, rule):
    schema = "battery_id string, cycle_index int, capacity_ah double, discharge_duration_s double"
    sound = spark.createDataFrame([("u", i, 2.0, 5.0) for i in (3, 1, 2)] + [("v", 1, 1.5, None)], schema)
    out = str(tmp_path / "cycles")
    tables.write_valid_cycles(sound, out)
    tables.write_valid_cycles(sound, out)
    with pytest.raises(DataValidationError, match=rule):
        tables.write_valid_cycles(spark.createDataFrame(FLAWS[rule], schema), out)
    assert sorted(spark.read.parquet(out).collect()) == sorted(sound.collect())
    assert [p.name for p in tmp_path.iterdir()] == ["cycles"]


def test_observed_counts_equal_the_query_over_chunks(spark):
    schema = "battery_id string, cycle_index int, capacity_ah double, discharge_duration_s double"
    rows = [(u, c, cap, dur) for u in ("a", "b", None) for c in (1, 2, 2, None, None, (1 << 20) + 1)
            for cap, dur in ((2.0, 1.0), (9.0, -1.0))]
    df = spark.createDataFrame(rows, schema)
    checked, seen = validate.observed(tables.clustered(df))
    assert checked.drop("_chunk").collect() and seen.get == validation_counts(df).first().asDict()


def test_a_stored_table_is_shuffled_once_and_sorted(spark, tmp_path):
    rows = spark.range(4000).select(
        F.concat(F.lit("u"), (F.col("id") % 7).cast("string")).alias("battery_id"),
        (F.floor(F.col("id") / 7) + 1).cast("int").alias("cycle_index"), F.lit(2.0).alias("capacity_ah"),
        F.lit(None).cast("timestamp_ntz").alias("cycle_start_time"),
        *[F.lit(1.0).alias(c) for c in ("discharge_duration_s", "voltage_min", "temp_max", "ambient_temperature",
                                        *CHARGE_COLUMNS)])
    built = build_features(rows, dense=True, keep_chunk=True)
    laid = tables.clustered(built).sortWithinPartitions("battery_id", "_chunk", "cycle_index")
    plan = laid._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort") == 1
    tables.write_unit_table(built, str(tmp_path / "t"))
    at = F.col("_metadata.row_index").alias("at")
    seen = spark.read.parquet(str(tmp_path / "t")).select("battery_id", "cycle_index", "_metadata.file_name", at).collect()
    assert len(seen) == 4000 and len({r.file_name for r in seen if r.battery_id == "u0"}) == 1
    for name in {r.file_name for r in seen}:
        own = [(r.battery_id, r.cycle_index) for r in sorted((r for r in seen if r.file_name == name), key=lambda r: r.at)]
        assert own == sorted(own)


def test_folders_of_one_file_are_listed_in_groups(spark, tmp_path):
    from unitlife.plans import views
    from unitlife.session import LISTING
    for unit in range(40):  # beyond 32 folders Spark lists by a job
        spark.createDataFrame([(f"U{unit}", [])], RAW_FILE).coalesce(1).write.parquet(f"{tmp_path}/raw/unit=U{unit}")
    before, most = spark.conf.get(LISTING), 4 * spark.sparkContext.defaultParallelism
    name = views.unit_of_folder
    try:
        for opened in (
                lambda: landing.list_files(spark, f"{tmp_path}/raw"),
                lambda: landing.read_unit_files(spark, f"{tmp_path}/raw", landing.list_files(spark, f"{tmp_path}/raw"), stem=name),
                lambda: landing_stream.land(spark, f"{tmp_path}/raw", f"{tmp_path}/landed", stem=name).awaitTermination()):
            spark.conf.set(LISTING, "10000")
            opened()
            assert int(spark.conf.get(LISTING)) == most
        assert landing.list_files(spark, f"{tmp_path}/raw").count() == 40
        spark.conf.set(LISTING, "3")  # fewer stay fewer
        landing.list_files(spark, f"{tmp_path}/raw")
        assert spark.conf.get(LISTING) == "3"
    finally:
        spark.conf.set(LISTING, before)


def test_unit_files_hold_one_row_each_and_keep_it(spark, tmp_path):
    import glob
    import os

    from unitlife.plans import views
    rows = [("U1", FILE), ("U2", FILE[:2]), ("U3", [])]
    for _ in range(2):  # a repeated write doubles nothing
        views.write_unit_files(spark.createDataFrame(rows, RAW_FILE).repartition(2), f"{tmp_path}/a b")
    files = sorted(glob.glob(f"{tmp_path}/a b/**/*", recursive=True, include_hidden=True))
    assert [os.path.relpath(f, f"{tmp_path}/a b") for f in files if os.path.isfile(f)] == [
        f"unit=U{k}/part-0.parquet" for k in (1, 2, 3)]
    found = spark.read.schema(RAW_FILE).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/a b")
    expected = spark.createDataFrame(rows, RAW_FILE)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    sizes = {r.path.split("unit=")[1][:2]: r.length for r in landing.list_files(spark, f"{tmp_path}/a b").collect()}
    assert sizes["U1"] > sizes["U2"] > sizes["U3"]


def test_a_task_reads_many_small_files(spark, tmp_path):
    from unitlife.plans import views
    from unitlife.session import OPEN_COST, OPENING
    before = spark.conf.get(OPENING, None)
    try:
        spark.conf.unset(OPENING)
        views.write_unit_files(spark.createDataFrame([(f"U{k}", FILE) for k in range(150)], RAW_FILE), f"{tmp_path}/raw")
        name = views.unit_of_folder
        read = lambda: landing.read_unit_files(
            spark, f"{tmp_path}/raw", landing.list_files(spark, f"{tmp_path}/raw"), stem=name)
        assert read().count() == 150 * len(FILE)
        assert int(spark.conf.get(OPENING)) == OPEN_COST
        scan = spark.read.schema(RAW_FILE).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/raw")
        assert scan.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1
        spark.conf.set(OPENING, "1MB")  # a given one stays
        assert read().count() == 150 * len(FILE) and spark.conf.get(OPENING) == "1MB"
    finally:
        spark.conf.unset(OPENING) if before is None else spark.conf.set(OPENING, before)


def test_unit_files_are_not_read_to_see_whether_units_fit_a_task(spark, tmp_path, monkeypatch):
    from unitlife.operators import ingest
    asked, running = [], ingest.running
    monkeypatch.setattr(ingest, "running", lambda *a, **k: asked.append(k["small"]) or running(*a, **k))
    land(spark, str(tmp_path), "U1", FILE)
    cycles = runs.ingest(spark, f"{tmp_path}/raw", f"{tmp_path}/out").cycles
    assert asked == [True] and cycles.count() == 2
