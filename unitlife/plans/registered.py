"""The registered queries: each maps (spark, sf_dir) to a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlife.functions.times import datevec_to_timestamp
from unitlife.functions.waveform import charge_summary, discharge_summary
from unitlife.operators import audit, drift, evaluate, features, ingest, models, projection, rul, splits, validate
from unitlife.operators.features import FEATURE_COLUMNS
from unitlife.plans import runs, views
from unitlife.plans.views import KEYS
from unitlife.schema import CHARGE_COLUMNS, DISCHARGE_COLUMNS, HORIZON_GRID, HORIZONS, DataValidationError
from unitlife.session import shared_folder
from unitlife.sources import tables
from unitlife.sources.landing import choose_files
from unitlife.streaming import landing_stream
from unitlife.streaming.drift_monitor import folder_sink, monitor, read_reports
from unitlife.streaming.landing_stream import land

# Enough digits to tell results apart, few enough to ignore summation order. Averages of values with
# six decimals over up to 127 rows have no rounding ties at twelve, hours from microseconds none at ten.
FINE, COARSE = 9, 6
TIE_FREE_MEAN, TIE_FREE_HOURS = 12, 10
DRIFT_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_constant"]
AS_OF = 30


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _features(spark, d, horizons=()) -> DataFrame:
    return features.build_features(views.fleet(spark, d), KEYS, horizons=horizons, dense=True, keep_chunk=True)


def _from_table(spark, d, horizons=()) -> DataFrame:
    """Assigned rows of the stored feature table, for queries that read them more than once."""
    rows = views.fleet_features(spark, d)
    if horizons:
        rows = features.add_horizon_targets(rows, horizons, KEYS, dense=True)
    return splits.assign_splits(rows, views.cohort(spark, d), views.excluded(spark, d), KEYS, check=False)


def _assigned(spark, d, horizons=()) -> DataFrame:
    return splits.assign_splits(
        _features(spark, d, horizons), views.cohort(spark, d), views.excluded(spark, d), KEYS, check=False)


def _train(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == "train")


def _held_out(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split").isin("val", "test"))


def _slope(assigned: DataFrame):
    """The train slope as a scalar subquery, so the query stays lazy."""
    return evaluate.fade_slope(_train(assigned)).scalar()


def _summary(points: DataFrame, spark, d) -> DataFrame:
    table = rul.rul_summary(points, KEYS, sized_by=views.events(spark, d).select("unit_id"))
    return _round(table, COARSE, "rul_mae_cycles", "rul_median_ae_cycles", "rul_max_ae_cycles")


# Ingest.

def skip_counts(spark, d):
    return ingest.skip_counts(views.routed_entries(spark, d), KEYS)


def charge_carry(spark, d):
    return ingest.attach_charges(
        views.routed_entries(spark, d), KEYS, dense=False,
        charge_columns=("charge_duration_s", "charge_current_end"))


SMALL_CHUNK, SMALL_LIMIT = 16, 1000  # so that the given tables take the ways for large units and columns


def fleet_chunked(spark, d):
    """The fleet, numbered and summed over chunks."""
    return views.fleet_from_events(spark, d, SMALL_CHUNK).select(
        "unit_id", "cycle_index", "file_cycle_number", "capacity_ah", "ambient_temperature")


def charge_carry_chunked(spark, d):
    return ingest.attach_charges(
        views.routed_entries(spark, d), KEYS, dense=False, chunk_rows=SMALL_CHUNK,
        charge_columns=("charge_duration_s", "charge_current_end"))


def ingest_run(spark, d):
    """Entries landed in the shared folder, ingested, validated, written and read back."""
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    views.raw_entries(spark, d).write.parquet(f"{folder}/entries")
    cycles = runs.ingest_entries(spark, f"{folder}/entries", f"{folder}/cycles").cycles
    return _round(cycles, FINE, "capacity_ah", *DISCHARGE_COLUMNS, *CHARGE_COLUMNS)


def _two_landings(spark, d, between) -> str:
    """Unit files in two landings; ``between(root)`` runs after each. Returns the folder of the run."""
    folder = f"{shared_folder(spark)}/landings-{uuid.uuid4().hex}"
    for landing in (0, 1):
        views.land_unit_files(spark, d, f"{folder}/raw", landing)
        between(folder)
    return folder


def _land(spark):
    return lambda folder: land(
        spark, f"{folder}/raw", f"{folder}/landed", stem=views.unit_of_folder).awaitTermination()


def ingest_landings(spark, d):
    """Unit files in two landings, each read once by the stream, then ingested: larger copies replace smaller ones."""
    folder = _two_landings(spark, d, _land(spark))
    cycles = runs.ingest_landed(spark, f"{folder}/landed", f"{folder}/cycles", stem=views.unit_of_folder).cycles
    return _round(cycles, FINE, "capacity_ah", *DISCHARGE_COLUMNS, *CHARGE_COLUMNS)


def ingest_files(spark, d):
    """The same files found and ingested at once."""
    folder = _two_landings(spark, d, lambda folder: None)
    cycles = runs.ingest(spark, f"{folder}/raw", f"{folder}/cycles", stem=views.unit_of_folder).cycles
    return _round(cycles, FINE, "capacity_ah", *DISCHARGE_COLUMNS, *CHARGE_COLUMNS)


def landed_copies(spark, d):
    """What each landing brought, and which copy of a unit counts."""
    folder = _two_landings(spark, d, _land(spark))
    files = landing_stream.landed_files(spark, f"{folder}/landed")
    chosen = landing_stream.read_landed(spark, f"{folder}/landed", views.unit_of_folder)[1]
    return files.join(chosen.select("file", "stem", "n_skipped"), "file").select(
        "batch", F.col("stem").alias("battery_id"), "n_skipped")


def rejections(spark, d):
    """The rule that stops the write of a table, which then keeps it and meets the next one, and what is left at last."""
    cycles = _flawed(spark, d)
    capacity = F.col("capacity_ah")
    mended = (
        cycles, cycles.filter(capacity.isNotNull()),
        cycles.filter(capacity.isNotNull()).groupBy("unit_id", "cycle_index").agg(
            F.min("capacity_ah").alias("capacity_ah"), F.min("discharge_duration_s").alias("discharge_duration_s")))
    steps = (*mended, mended[2].filter((capacity > 0) & (capacity < 3.2)),
             mended[2].filter((capacity > 0) & (capacity < 3.2) & (F.col("discharge_duration_s") > 0)), cycles.limit(0))
    folder = f"{shared_folder(spark)}/rejections-{uuid.uuid4().hex}"
    found = []
    for step, table in enumerate(steps):
        try:
            tables.write_valid_cycles(table, folder, KEYS)
            found.append((step, "none", 0))
        except DataValidationError as error:
            found.append((step, error.rule, error.rows))
    broken = spark.createDataFrame(found, "step int, rule string, n_rows bigint")
    left = spark.read.schema(steps[4].schema).parquet(folder).agg(F.count("*").alias("n_rows"))
    return broken.unionByName(left.select(F.lit(len(steps)).alias("step"), F.lit("written").alias("rule"), "n_rows"))


def waveform_summaries(spark, d):
    samples = F.col("embedding").cast("array<double>")
    entries = views.table(spark, d, "embeddings").select("vec_id", F.struct(
        samples.alias("voltage_measured"), F.reverse(samples).alias("current_measured"),
        F.array_sort(samples).alias("temperature_measured"), samples.alias("time")).alias("data"))
    summaries = discharge_summary() | charge_summary()
    return entries.select("vec_id", *[F.round(c, FINE).alias(n) for n, c in summaries.items()])


def datevec_times(spark, d):
    ts = F.col("ts")
    vec = F.array(*[f(ts).cast("double") for f in (F.year, F.month, F.day, F.hour, F.minute)],
                  F.extract(F.lit("SECOND"), ts).cast("double") + 37.25)
    return views.events(spark, d).select("event_id", datevec_to_timestamp(vec).alias("start_time"))


def largest_copy(spark, d):
    listing = views.table(spark, d, "pages").select(
        F.col("url").alias("path"), F.octet_length("html").alias("length"))
    return choose_files(listing)


def _flawed(spark, d):
    return views.events(spark, d).select(
        "unit_id", F.floor(F.col("event_id") / 40).alias("cycle_index"),
        F.when(F.col("event_type") != "error", F.col("value") / 10).alias("capacity_ah"),
        (F.col("value") - 5).alias("discharge_duration_s"))


def validation_counts(spark, d):
    return validate.validation_counts(_flawed(spark, d), KEYS)


def capacity_examples(spark, d):
    return validate.capacity_examples(_flawed(spark, d), KEYS)


# Features and targets.

def feature_build(spark, d):
    built = _round(_features(spark, d).select("unit_id", "soh", *FEATURE_COLUMNS), FINE,
                   "soh_roll_mean", "soh_roll_std", "fade_rate", "voltage_min_prev", "temp_max_prev",
                   "charge_temp_max", "charge_current_end")
    return _round(built, TIE_FREE_HOURS, "time_since_prev_cycle_h")


def feature_build_as_of(spark, d):
    seen = features.build_features(views.fleet(spark, d), KEYS, as_of=AS_OF, dense=True)
    return _round(seen.select("unit_id", "cycle_index", "soh", "soh_prev", "soh_roll_mean", "soh_roll_std",
                              "fade_rate"), FINE, "soh_roll_mean", "soh_roll_std", "fade_rate")


def feature_coverage(spark, d):
    """The registry next to what the data holds for each feature."""
    names = [name for name, _, _ in features.REGISTRY]
    present = drift.long_form(views.fleet_features(spark, d), names).groupBy("feature").agg(
        F.count("x").alias("n_present"), F.count_if(F.col("x").isNull()).alias("n_missing"))
    return present.join(F.broadcast(features.feature_table(spark)), "feature").select(
        "feature", "included", "n_present", "n_missing")


def horizon_targets(spark, d):
    cycles = views.soh_of(views.fleet(spark, d)).select("unit_id", "cycle_index", "soh")
    return features.add_horizon_targets(cycles, HORIZONS, KEYS, dense=True)


def grid_labels(spark, d):
    return models.grid_label_counts(_train(_from_table(spark, d, HORIZON_GRID)))


def seen_and_future(spark, d):
    fleet = views.fleet(spark, d)
    part = lambda df, name: df.groupBy("unit_id").agg(F.count("*").alias("n")).withColumn("part", F.lit(name))
    return part(features.up_to(fleet, AS_OF, KEYS), "seen").unionByName(
        part(features.from_cycle(fleet, AS_OF, KEYS), "future"))


# Splits.

def split_assignment(spark, d):
    return splits.assign_splits(
        views.fleet(spark, d).select("unit_id", "cycle_index"), views.cohort(spark, d),
        views.excluded(spark, d), KEYS, check=False)


def split_sizes(spark, d):
    return splits.split_sizes(split_assignment(spark, d), KEYS)


def split_units(spark, d):
    return splits.split_units(split_assignment(spark, d), KEYS)


def _partial_cohort(spark, d):
    return views.cohort(spark, d).filter(F.col("split") != "test")


def unknown_units(spark, d):
    return splits.unknown_units(
        views.fleet(spark, d), _partial_cohort(spark, d), views.excluded(spark, d), KEYS)


def excluded_present(spark, d):
    return splits.excluded_present(views.fleet(spark, d), views.excluded(spark, d), KEYS)


def _doubled_cohort(spark, d):
    again = views.units(spark, d).filter(F.col("unit_id") % 4 == 3).select("unit_id", F.lit("test").alias("split"))
    return views.cohort(spark, d).unionByName(again)


def leaked_units(spark, d):
    assigned = splits.assign_splits(
        views.fleet(spark, d).select("unit_id", "cycle_index"), _doubled_cohort(spark, d),
        views.excluded(spark, d), KEYS, check=False)
    return splits.leaked_units(assigned, KEYS)


def cohort_mismatch(spark, d):
    return splits.cohort_mismatch(
        views.fleet(spark, d), _partial_cohort(spark, d), views.excluded(spark, d), KEYS)


def cohort_problems(spark, d):
    return splits.cohort_problems(
        _doubled_cohort(spark, d).withColumn(
            "split", F.when(F.col("unit_id") % 10 == 7, "holdout").otherwise(F.col("split"))),
        views.excluded(spark, d), KEYS)


# Forecast metrics.

def fade_slope(spark, d):
    return _round(evaluate.fade_slope(_train(_assigned(spark, d))), FINE, "slope")


def _baseline_metrics(spark, d):
    assigned = _assigned(spark, d, HORIZONS)
    held_out = _held_out(assigned).withColumn("train_slope", _slope(assigned))
    errors = evaluate.forecast_errors(
        held_out, evaluate.baselines(F.col("train_slope"), HORIZONS), KEYS)
    return evaluate.unit_metrics(errors, KEYS)


def baseline_metrics(spark, d):
    metrics = _round(_baseline_metrics(spark, d), TIE_FREE_MEAN, "mae", "rmse")
    return _round(metrics, COARSE, "r2")


def leakage_suspects(spark, d):
    """With the slope baseline exempt and the last-value one judged like a model."""
    suspects = evaluate.leakage_suspects(_baseline_metrics(spark, d), 0.5, exempt="baseline_global")
    return suspects.select("split", "method", "horizon", "unit_id", F.round("r2", COARSE).alias("r2"))


def metrics_report(spark, d):
    return _round(evaluate.metrics_view(_baseline_metrics(spark, d), KEYS), TIE_FREE_MEAN, "mae", "rmse")


# Remaining life.

def rul_points(spark, d):
    assigned = _assigned(spark, d)
    held_out = _held_out(assigned)
    points = rul.rul_points(held_out, _slope(assigned), held_out, keys=KEYS)
    return _round(points, 4, "rul_pred")


def _life_records(spark, d):
    """Points of the slope method and their summary, written as JSON records and read back."""
    assigned = _assigned(spark, d)
    held_out = _held_out(assigned)
    points = rul.rul_points(held_out, _slope(assigned), held_out, keys=KEYS)
    folder = f"{shared_folder(spark)}/rul-{uuid.uuid4().hex}"
    return tables.write_rul(points, folder, lambda p: rul.rul_summary(p, KEYS))


def rul_records(spark, d):
    return _round(_life_records(spark, d)[0], 4, "rul_pred")


def rul_summary_records(spark, d):
    return _round(_life_records(spark, d)[1], COARSE, "rul_mae_cycles", "rul_median_ae_cycles", "rul_max_ae_cycles")


def rul_slope_error(spark, d):
    """The flagship: error of the slope-projected remaining life per held-out unit and threshold."""
    assigned = _assigned(spark, d)
    held_out = _held_out(assigned)
    return _summary(rul.rul_points(held_out, _slope(assigned), held_out, keys=KEYS), spark, d)


def rul_slope_error_chunked(spark, d):
    """The same over chunks of a few cycles, medians by counted histograms."""
    df = features.build_features(views.fleet(spark, d), KEYS, dense=True, keep_chunk=True, chunk_rows=SMALL_CHUNK)
    assigned = splits.assign_splits(df, views.cohort(spark, d), views.excluded(spark, d), KEYS, check=False)
    held_out = _held_out(assigned)
    points = rul.rul_points(held_out, _slope(assigned), held_out, keys=KEYS, chunk_rows=SMALL_CHUNK)
    table = rul.rul_summary(points, KEYS, limit=SMALL_CHUNK)
    return _round(table, COARSE, "rul_mae_cycles", "rul_median_ae_cycles", "rul_max_ae_cycles")


def rul_trajectory_points(spark, d):
    """The crossing rule on the observed future as trajectory, over the whole fleet."""
    df = _features(spark, d, HORIZON_GRID)
    points = rul.rul_points(
        df, -0.005, trajectory={k: F.col(features.horizon_target(k)) for k in HORIZON_GRID},
        trajectory_method="observed_trajectory", keys=KEYS)
    return _round(points.filter(F.col("method") == "observed_trajectory"), COARSE, "rul_pred")


def rul_trajectory_error(spark, d):
    """Slope and straight-line trajectory side by side: equal from the first horizon on."""
    assigned = _assigned(spark, d)
    held_out = _held_out(assigned)
    held_out = held_out.withColumn("train_slope", _slope(assigned))
    slope = F.col("train_slope")
    line = {k: evaluate.global_slope_baseline(slope, k) for k in HORIZON_GRID}
    points = rul.rul_points(held_out, slope, held_out, trajectory=line,
                            trajectory_method="baseline_trajectory", keys=KEYS)
    return _summary(points, spark, d)


def eol_cycles(spark, d):
    return rul.eol_cycles(views.soh_of(views.fleet(spark, d)), keys=KEYS)


def censored_units(spark, d):
    cycles = splits.assign_splits(
        views.soh_of(views.fleet(spark, d)), views.cohort(spark, d), views.excluded(spark, d), KEYS, check=False)
    censored = rul.censored_units(rul.eol_cycles(cycles, keys=KEYS))
    return censored.join(views.cohort(spark, d), "unit_id")


# Drift.

def _line_items(spark, d):
    return views.table(spark, d, "lineitem").select(
        "l_shipdate", *DRIFT_COLUMNS[:-1], F.lit(7.0).alias("l_constant"))


def _reference_items(spark, d):
    return _line_items(spark, d).filter(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))


def _current_items(spark, d):
    return _line_items(spark, d).filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))


def drift_report(spark, d):
    report = drift.drift_report(
        _reference_items(spark, d), _current_items(spark, d), DRIFT_COLUMNS, digits=FINE)
    return _round(report, FINE, "psi")


def worst_drift(spark, d):
    report = drift.drift_by(_reference_items(spark, d), _current_items(spark, d), DRIFT_COLUMNS, digits=FINE)
    return _round(drift.worst_feature(report), FINE, "psi")


def drift_edges(spark, d):
    edges = drift.reference_edges(_reference_items(spark, d), DRIFT_COLUMNS, digits=FINE)
    return edges.select("feature", "n", F.posexplode("edges").alias("position", "edge")).withColumn(
        "edge", F.round("edge", FINE))


def drift_edges_narrowed(spark, d):
    """The edges by counted histograms, as for columns beyond the limit of a task."""
    edges = drift.reference_edges(_reference_items(spark, d), DRIFT_COLUMNS, digits=FINE, limit=SMALL_LIMIT)
    return edges.select("feature", "n", F.posexplode("edges").alias("position", "edge")).withColumn(
        "edge", F.round("edge", FINE))


def drift_histogram(spark, d):
    reference = _reference_items(spark, d)
    edges = drift.fit_edges(reference, DRIFT_COLUMNS, digits=FINE)
    wide = drift.histogram(_current_items(spark, d), edges)
    return wide.select("feature", F.inline(F.array(*[
        F.struct(F.lit(i).alias("bin"), F.col(f"c{i}").alias("n")) for i in range(10)])))


def _settled(df: DataFrame) -> DataFrame:
    """Features cut to ten digits: a value that equals an edge must not miss it by its last bit."""
    return _round(df, TIE_FREE_HOURS, *[c for c in FEATURE_COLUMNS if c != KEYS.cycle])


def drift_by_split(spark, d):
    assigned = _settled(_from_table(spark, d))
    report = drift.drift_by(_train(assigned), _held_out(assigned), FEATURE_COLUMNS, ["split"], digits=FINE)
    return _round(report, FINE, "psi")


def drift_by_unit(spark, d):
    assigned = _settled(_from_table(spark, d))
    report = drift.drift_by(_train(assigned), _held_out(assigned), FEATURE_COLUMNS, ["split", "unit_id"], digits=FINE)
    return _round(report, FINE, "psi")


def _silenced(df: DataFrame) -> DataFrame:
    """Some units cut to twelve cycles, some without one of the features."""
    short = F.col("unit_id") % 5 == 0
    return df.filter(~short | (F.col("cycle_index") <= 12)).withColumn(
        "charge_current_end", F.when(F.col("unit_id") % 3 != 1, F.col("charge_current_end")))


def drift_by_unit_silenced(spark, d):
    assigned = _settled(_from_table(spark, d))
    report = drift.drift_by(
        _train(assigned), _silenced(_held_out(assigned)), FEATURE_COLUMNS, ["split", "unit_id"], digits=FINE)
    return _round(report, FINE, "psi")


SLICES = 4


def drift_stream(spark, d):
    """Line items landing in slices, the monitor started anew after each, and once more when nothing is new."""
    run = f"{shared_folder(spark)}/drift-stream-{uuid.uuid4().hex}"
    columns = "l_orderkey", "l_shipdate", *DRIFT_COLUMNS[:-1]
    items = views.table(spark, d, "lineitem").select(*columns)
    reference = _reference_items(spark, d)
    fitted = drift.fit_reference(reference, DRIFT_COLUMNS, digits=FINE)
    for part in range(SLICES + 1):
        if part < SLICES:
            items.filter(F.col("l_orderkey") % SLICES == part).write.parquet(f"{run}/in/slice{part}")
        stream = spark.readStream.schema(items.schema).option("recursiveFileLookup", "true").parquet(f"{run}/in")
        monitor(stream.withColumn("l_constant", F.lit(7.0)), reference, DRIFT_COLUMNS, folder_sink(f"{run}/reports"),
                f"{run}/checkpoint", digits=FINE, fitted=fitted).awaitTermination()
    return _round(read_reports(spark, f"{run}/reports"), FINE, "psi")


# Projection and point in time.

def _steep(slope) -> dict:
    """A line twice as steep as the fleet's, in the place of a fitted model's trajectory."""
    return {k: evaluate.global_slope_baseline(2 * slope, k) for k in HORIZON_GRID}


def projections(spark, d):
    assigned = _from_table(spark, d)
    slope = F.col("train_slope")
    held_out = _held_out(assigned).withColumn("train_slope", _slope(assigned))
    curves = projection.projections(held_out, slope, HORIZON_GRID, trajectory=_steep(slope), keys=KEYS)
    return _round(curves, FINE, "soh")


def _standing(spark, d):
    return projection.standing_points(views.fleet(spark, d), keys=KEYS).select("unit_id", "cycle_index")


def point_in_time(spark, d):
    assigned = _from_table(spark, d)
    lived = views.fleet_features(spark, d).withColumn("train_slope", _slope(assigned))
    answers = projection.point_in_time(
        lived, _standing(spark, d), F.col("train_slope"), trajectory=_steep(F.col("train_slope")),
        cycles=views.soh_of(views.fleet(spark, d)), keys=KEYS)
    return _round(answers, 4, "rul_baseline", "delta_baseline", "rul_model", "delta_model")


def _ridge_curves(spark, d):
    """Held-out rows with the curve of a ridge at every grid horizon that has enough labels, the train slope, and the models."""
    assigned = _from_table(spark, d, HORIZON_GRID)
    fitted = models.train_grid(
        _train(assigned), _held_out(assigned), grid=HORIZON_GRID, keys=KEYS, fit=models.ridge_fit)
    rows = models.with_trajectory(_held_out(assigned), fitted).withColumn("train_slope", _slope(assigned))
    return rows, fitted


def projections_fitted(spark, d):
    """Curves of a fitted model at the standing points of the held-out units."""
    rows, fitted = _ridge_curves(spark, d)
    curves = projection.projections(
        rows, F.col("train_slope"), sorted(fitted), trajectory=models.trajectory_columns(fitted), keys=KEYS)
    return _round(curves, COARSE, "soh")


def point_in_time_fitted(spark, d):
    """Answers of a fitted model at the standing points of the held-out units."""
    rows, fitted = _ridge_curves(spark, d)
    answers = projection.point_in_time(
        rows, _standing(spark, d), F.col("train_slope"), trajectory=models.trajectory_columns(fitted),
        cycles=views.soh_of(views.fleet(spark, d)), keys=KEYS)
    return _round(_round(answers, 4, "rul_baseline", "delta_baseline"), 3, "rul_model", "delta_model")


def _prefix_drift(spark, d):
    return projection.prefix_drift(
        _settled(views.fleet_features(spark, d)), _standing(spark, d), _settled(_train(_from_table(spark, d))),
        FEATURE_COLUMNS, keys=KEYS, digits=FINE)


def prefix_drift(spark, d):
    return _round(_prefix_drift(spark, d), FINE, "psi")


def prefix_drift_silenced(spark, d):
    lived = _silenced(views.fleet_features(spark, d))
    standing = projection.standing_points(lived, keys=KEYS).select("unit_id", "cycle_index")
    report = projection.prefix_drift(
        _settled(lived), standing, _settled(_train(_from_table(spark, d))), FEATURE_COLUMNS, keys=KEYS, digits=FINE)
    return _round(report, FINE, "psi")


def worst_prefix_drift(spark, d):
    return _round(projection.worst_prefix_drift(_round(_prefix_drift(spark, d), FINE, "psi"), KEYS), FINE, "psi")


# Audit.

def fleet_audit(spark, d):
    return audit.fleet_audit(views.soh_of(views.fleet(spark, d)), KEYS)


def ambient_settings(spark, d):
    return audit.ambient_settings(views.fleet(spark, d), KEYS)


def _runs(spark, d):
    return audit.classify_runs(views.soh_of(views.fleet(spark, d)), KEYS, limit=0.70)


def run_classes(spark, d):
    return _round(_runs(spark, d), FINE, "voltage_min")


def aborted_runs(spark, d):
    return audit.aborted_runs(_runs(spark, d), KEYS)


def hot_cycles(spark, d):
    return audit.hot_cycles(views.soh_of(views.fleet(spark, d))).select("unit_id", "cycle_index", "soh")


def fleet_size(spark, d):
    return audit.fleet_size(views.fleet(spark, d), KEYS)


# Models.

def feature_medians(spark, d):
    train = _train(_from_table(spark, d))
    bound = views.fleet_features(spark, d).count()  # from the stored table's footers
    return _round(models.feature_statistics(train, FEATURE_COLUMNS, at_most=bound), COARSE, "median", "mean", "std")


def feature_medians_narrowed(spark, d):
    train = _train(_from_table(spark, d))
    return _round(models.feature_statistics(train, FEATURE_COLUMNS, SMALL_LIMIT), COARSE, "median", "mean", "std")


def _ridges(train: DataFrame, horizons) -> dict:
    of_target = {features.horizon_target(k): k for k in horizons}
    return {of_target[t]: m for t, m in models.train_ridges(train, FEATURE_COLUMNS, list(of_target)).items()}


def ridge_forecast(spark, d):
    """The ridge over all features at every report horizon, applied to the held-out units."""
    assigned = _from_table(spark, d, HORIZONS)
    return _forecast_rows(assigned, _ridges(_train(assigned), HORIZONS))


def _forecast_rows(assigned: DataFrame, fitted: dict) -> DataFrame:
    scored = models.predict(_held_out(assigned), {
        f"_p{k}": model for k, model in fitted.items()})
    entries = [F.struct(F.lit(k).alias("horizon"), F.when(
        F.col("soh_prev").isNotNull() & F.col(features.horizon_target(k)).isNotNull(), F.col(f"_p{k}")).alias("prediction"))
        for k in HORIZONS]
    long = scored.select("unit_id", "cycle_index", F.inline(F.array(*entries)))
    return _round(long.filter(F.col("prediction").isNotNull()), COARSE, "prediction")


def _ridge_metrics(assigned: DataFrame, fitted: dict) -> DataFrame:
    slope = evaluate.fade_slope(_train(assigned)).first()["slope"]
    return runs.soh_metrics(
        assigned, {("ridge_autoregressive", k): m for k, m in fitted.items()}, slope, HORIZONS, KEYS)


def _settled_metrics(metrics: DataFrame) -> DataFrame:
    fine = F.col("method").startswith("baseline")  # the models' last digits depend on the solver
    return metrics.withColumns({
        c: F.when(fine, F.round(c, TIE_FREE_MEAN)).otherwise(F.round(c, COARSE)) for c in ("mae", "rmse")})


def ridge_metrics(spark, d):
    """The ridge variant at every report horizon next to the baselines."""
    assigned = _from_table(spark, d, HORIZONS)
    return _round(_settled_metrics(_ridge_metrics(assigned, _ridges(_train(assigned), HORIZONS))), COARSE, "r2")


def _artifacts(spark, d) -> str:
    """The folder of a version: ridges, configuration and metrics."""
    def save(root: str) -> None:
        assigned = _from_table(spark, d, HORIZONS)
        fitted = _ridges(_train(assigned), HORIZONS)
        tables.save_artifacts({f"ridge_h{k}": m for k, m in fitted.items()}, models.TrainConfig(),
                              _ridge_metrics(assigned, fitted), root)
    return f"{views.folder_once(spark, d, 'artifacts', save)}/soh_v{models.TrainConfig().version}"


def artifact_metrics(spark, d):
    """The metrics of a published version, read from its JSON records."""
    schema = tables.METRICS.replace("battery_id string", "unit_id bigint")
    metrics = tables.read_records(spark, f"{_artifacts(spark, d)}/metrics", schema)
    return _round(_settled_metrics(metrics), COARSE, "r2")


def artifact_forecast(spark, d):
    """Forecasts of the models loaded from a published version."""
    folder = _artifacts(spark, d)
    return _forecast_rows(
        _from_table(spark, d, HORIZONS), {k: tables.load_model(spark, folder, f"ridge_h{k}") for k in HORIZONS})


def _life_run(spark, d, folder: str) -> runs.Lives:
    """The whole run of remaining life with a ridge at every grid horizon that has enough labels."""
    assigned = _from_table(spark, d, HORIZON_GRID)
    grid = models.train_grid(
        _train(assigned), _held_out(assigned), grid=HORIZON_GRID, keys=KEYS, fit=models.ridge_fit)
    return runs.forecast_rul(
        views.fleet_features(spark, d), cohort=views.cohort(spark, d), excluded=views.excluded(spark, d), models=grid,
        out=folder, keys=KEYS, dense=True)


def rul_run_censored(spark, d):
    """Held-out units of that run which never reach a threshold."""
    folder = f"{shared_folder(spark)}/rul-run-{uuid.uuid4().hex}"
    return _life_run(spark, d, folder).censored


def _report(spark, d, name: str) -> DataFrame:
    """A table of the written report on that run."""
    def write(folder: str) -> None:
        assigned = _from_table(spark, d, HORIZONS)
        metrics = _ridge_metrics(assigned, _ridges(_train(assigned), HORIZONS))
        lives = _life_run(spark, d, f"{folder}/lives")
        runs.write_report(runs.report_tables(
            _settled(views.fleet_features(spark, d)), metrics, lives.summary, lives.models,
            cohort=views.cohort(spark, d), excluded=views.excluded(spark, d), keys=KEYS, digits=FINE), f"{folder}/report")
    return spark.read.parquet(f"{views.folder_once(spark, d, 'report', write)}/report/{name}")


def report_soh(spark, d):
    return _settled_metrics(_report(spark, d, "soh"))


def report_rul(spark, d):
    return _round(_report(spark, d, "rul"), 3, "rul_mae_cycles", "rul_median_ae_cycles", "rul_max_ae_cycles")


def report_drift(spark, d):
    return _round(_report(spark, d, "drift"), FINE, "psi")


def report_projection(spark, d):
    return _round(_report(spark, d, "projection"), COARSE, "soh")


def _forests(spark, d, config) -> DataFrame:
    """Errors of both boosted variants as configured by default, at every report horizon, next to the baselines."""
    assigned = _from_table(spark, d, config.horizons)
    kept = runs.training_columns(assigned, config.horizons, KEYS).persist()
    frames = splits.split_frames(kept)
    try:
        fitted = models.train_variants(
            frames["train"], frames["val"], config, KEYS, only=("gbt_autoregressive", "gbt_telemetry"))
        slope = evaluate.fade_slope(frames["train"]).first()["slope"]
    finally:
        kept.unpersist()
    return runs.soh_metrics(assigned, fitted, slope, config.horizons, KEYS)


def _boosted(spark, d) -> DataFrame:
    return views.stored(spark, d, "boosted-errors", lambda: _forests(spark, d, models.TrainConfig()))


def boosted_metrics(spark, d):
    """Row counts of both boosted variants, and the baselines.

    The trees' own errors have no SQL counterpart: they are NULL here; ``boosted_errors`` has them, from the same fit.
    """
    settled = F.col("method").startswith("baseline")
    digits = {"mae": TIE_FREE_MEAN, "rmse": TIE_FREE_MEAN, "r2": COARSE}
    return _boosted(spark, d).withColumns({c: F.when(settled, F.round(c, n)) for c, n in digits.items()})


def boosted_errors(spark, d):
    """The errors of both boosted variants next to the baselines'."""
    return _round(_boosted(spark, d), COARSE, "mae", "rmse", "r2")


def _grid_lives(spark, d, fit, method: str) -> DataFrame:
    """Error summary of remaining life by the slope method and by a fitted grid."""
    assigned = _from_table(spark, d, HORIZON_GRID)
    kept = runs.training_columns(assigned, HORIZON_GRID, KEYS)
    if fit is None:
        kept = kept.persist()  # a ridge keeps what it reads itself
    frames = splits.split_frames(kept)
    try:
        fitted = models.train_grid(frames["train"], frames["val"], grid=HORIZON_GRID, keys=KEYS, fit=fit)
    finally:
        if fit is None:
            kept.unpersist()
    held_out = _held_out(assigned)
    points = rul.rul_points(
        models.with_trajectory(held_out, fitted), _slope(assigned), held_out,
        trajectory=models.trajectory_columns(fitted), trajectory_method=method, keys=KEYS)
    return rul.rul_summary(points, KEYS, sized_by=views.events(spark, d).select("unit_id"))


def rul_model_error(spark, d):
    """Remaining life from a ridge at every grid horizon that has enough labels, against the slope method."""
    table = _grid_lives(spark, d, models.ridge_fit, "ridge_trajectory")
    return _round(table, 3, "rul_mae_cycles", "rul_median_ae_cycles", "rul_max_ae_cycles")


def _boosted_lives(spark, d) -> DataFrame:
    return views.stored(spark, d, "boosted-lives", lambda: _grid_lives(spark, d, None, "gbt_trajectory"))


def rul_boosted_counts(spark, d):
    """The default grid of boosted trees: points of both methods, and the slope method's errors.

    What the trees predict has no SQL counterpart, so their errors and censored predictions are NULL here;
    ``rul_boosted_error`` has them, from the same fit.
    """
    settled = F.col("method") == "global_slope"
    return _boosted_lives(spark, d).withColumns({
        "n_censored_preds": F.when(settled, F.col("n_censored_preds")),
        **{c: F.when(settled, F.round(c, 3)) for c in ("rul_mae_cycles", "rul_median_ae_cycles", "rul_max_ae_cycles")}})


def rul_boosted_error(spark, d):
    """Remaining life from boosted trees at every grid horizon that has enough labels, against the slope method."""
    return _round(_boosted_lives(spark, d), 3, "rul_mae_cycles", "rul_median_ae_cycles", "rul_max_ae_cycles")


_QUERIES = (
    ingest_run, ingest_landings, ingest_files, landed_copies, rejections, skip_counts, charge_carry, charge_carry_chunked, fleet_chunked, drift_edges_narrowed, drift_by_unit_silenced,
    prefix_drift_silenced, rul_slope_error_chunked, feature_medians_narrowed, waveform_summaries, datevec_times, largest_copy, validation_counts,
    capacity_examples, feature_build, feature_build_as_of, feature_coverage, horizon_targets, grid_labels,
    seen_and_future, split_assignment, split_sizes, split_units, unknown_units, excluded_present,
    leaked_units, cohort_mismatch, cohort_problems, fade_slope, baseline_metrics, leakage_suspects,
    metrics_report, rul_points, rul_records, rul_summary_records, rul_slope_error, rul_trajectory_points, rul_trajectory_error, eol_cycles,
    censored_units, drift_report, worst_drift, drift_edges, drift_histogram, drift_by_split, drift_by_unit,
    drift_stream, projections, point_in_time, projections_fitted, point_in_time_fitted, prefix_drift, worst_prefix_drift, fleet_audit,
    ambient_settings, run_classes, aborted_runs, hot_cycles, fleet_size, feature_medians, ridge_forecast,
    ridge_metrics, artifact_metrics, artifact_forecast, rul_run_censored, report_soh, report_rul, report_drift, report_projection,
    boosted_metrics, boosted_errors, rul_model_error, rul_boosted_counts, rul_boosted_error,
)


def queries() -> dict:
    return {query.__name__: query for query in _QUERIES}
