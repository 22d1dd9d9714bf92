"""Table readers and writers."""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from unitlife.operators import models, validate
from unitlife.operators.ordered import CHUNK, ensure_chunk
from unitlife.schema import CYCLES, FEATURES, Keys
from unitlife.session import folder_exists, publish_folder, remove_folder

METRICS = (
    "split string, method string, horizon int, battery_id string, n bigint, mae double, rmse double, r2 double")
RUL_SUMMARY = (
    "battery_id string, threshold double, method string, n_points bigint, n_censored_preds bigint, "
    "rul_mae_cycles double, rul_median_ae_cycles double, rul_max_ae_cycles double")
RUL_POINTS = (
    "battery_id string, cycle_index int, method string, threshold double, rul_true double, rul_pred double")


def read_cycles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CYCLES).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURES).parquet(path)


def read_records(spark: SparkSession, path: str, schema: str | T.StructType = METRICS, *, lines: bool = True) -> DataFrame:
    """JSON records: one per line, or (``lines=False``) one array per file."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def read_rul(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, summary) of one RUL run."""
    return (read_records(spark, f"{path}/predictions", RUL_POINTS),
            read_records(spark, f"{path}/summary", RUL_SUMMARY))


def clustered(df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Hashed by (unit, chunk), the chunk column added: a large unit is spread over several partitions, a small one is
    together. Rows that have their chunk column come out of a shuffle on it and are not shuffled again; nothing is
    sampled, so what is above runs once."""
    return df if CHUNK in df.columns else ensure_chunk(df, keys.cycle).repartition(keys.unit, CHUNK)


def write_unit_table(df: DataFrame, path: str, keys: Keys = Keys(), mode: str = "overwrite") -> None:
    """Parquet, each file sorted by (unit, cycle), so that unit filters skip row groups and pages by their statistics
    without one directory per unit."""
    (clustered(df, keys).sortWithinPartitions(keys.unit, CHUNK, keys.cycle).drop(CHUNK)
     .write.mode(mode).parquet(path))


def write_valid_cycles(cycles: DataFrame, path: str, keys: Keys = Keys()) -> None:
    """The cycle table, counted against the rules while it is written aside, and published by a rename if it keeps them.

    One pass. A broken rule raises ``DataValidationError`` and leaves neither a new table nor a changed old one.
    """
    spark = cycles.sparkSession
    aside = f"{path}.building-{uuid.uuid4().hex}"
    rows, seen = validate.observed(clustered(cycles, keys), keys)
    try:
        rows.drop(CHUNK).write.parquet(aside)
        written = spark.read.schema(cycles.schema).parquet(aside)
        validate.require_valid(seen.get, lambda: validate.capacity_examples(written, keys), keys)
        remove_folder(spark, path)
        if not publish_folder(spark, aside, path):
            raise FileExistsError(f"{path} was written by another run")
        spark.catalog.refreshByPath(path)
    except BaseException:
        remove_folder(spark, aside)
        raise


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; a missing value is written as null."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_rul(points: DataFrame, path: str, summarise, mode: str = "overwrite") -> tuple[DataFrame, DataFrame]:
    """Write the points, summarise what was written (not a second run of the models), write that."""
    write_records(points, f"{path}/predictions", mode)
    written = points.sparkSession.read.schema(points.schema).json(f"{path}/predictions")
    summary = summarise(written)
    write_records(summary, f"{path}/summary", mode)
    return written, points.sparkSession.read.schema(summary.schema).json(f"{path}/summary")


def save_artifacts(fitted: Mapping[str, models.Model], config, metrics: DataFrame, root: str) -> str:
    """A new versioned folder with models, configuration and metrics; an existing one is an error.

    All is written aside and published by one rename, so a run that fails half way leaves the version free.
    """
    folder = f"{root}/soh_v{config.version}"
    spark = metrics.sparkSession
    if folder_exists(spark, folder):
        raise FileExistsError(f"{folder} exists; choose a new version")
    aside = f"{folder}.building-{uuid.uuid4().hex}"
    settings = json.dumps(dataclasses.asdict(config), default=dict)
    try:
        spark.createDataFrame([(settings,)], "value string").coalesce(1).write.text(f"{aside}/config")
        for name, model in fitted.items():
            models.save_model(spark, model, f"{aside}/models/{name}")
        write_records(metrics, f"{aside}/metrics", "errorifexists")
        if not publish_folder(spark, aside, folder):
            raise FileExistsError(f"{folder} exists; choose a new version")
    except BaseException:
        remove_folder(spark, aside)
        raise
    return folder


def load_model(spark: SparkSession, folder: str, name: str) -> models.Model:
    return models.load_model(spark, f"{folder}/models/{name}")
