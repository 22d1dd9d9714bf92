"""The given tables seen as a fleet: users are units, their events are cycles.

``fleet`` has one row per event: the cycle number counts the user's events and health falls with
the value used up so far. Telemetry columns are plain functions of the event.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from unitlife.operators.features import build_features
from unitlife.operators.ingest import route
from unitlife.operators.ordered import CHUNK, CHUNK_ROWS, running
from unitlife.schema import RAW_ENTRY, Keys
from unitlife.session import shared_folder
from unitlife.sources.tables import write_unit_table

_staged: dict[tuple, str] = {}
_schemas: dict[str, StructType] = {}

KEYS = Keys("unit_id", "cycle_index")


# Declared, so that opening a table does not start a job that reads file footers.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumnRenamed("user_id", "unit_id")


def _state(spark: SparkSession, path: str) -> tuple:
    """Number, total size and last change of the files of a table, from their listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return path, *files.agg(F.count("*"), F.sum("length"), F.max("modificationTime")).first()


def folder_once(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """A folder of the shared one that ``write(path)`` fills once per session and state of the events."""
    key = (spark.sparkContext.applicationId, _state(spark, f"{sf_dir}/events.parquet"), name)
    if key not in _staged:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        write(path)
        _staged[key] = path
    return _staged[key]


def _once(spark: SparkSession, sf_dir: str, name: str, build, write) -> DataFrame:
    def fill(path: str) -> None:
        table = build()
        write(table, path)
        _schemas[path] = StructType([f for f in table.schema if f.name != CHUNK])

    path = folder_once(spark, sf_dir, name, fill)
    return spark.read.schema(_schemas[path]).parquet(path)


def _stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table written once per session and state of its input to the shared folder, and read from there.

    Later stages start from the stored table, so column pruning and pushed filters apply and a
    lost executor costs a re-read, not a re-run of what came before. Files that change, come or go make a new one.
    """
    return _once(spark, sf_dir, name, build, lambda table, path: write_unit_table(table, path, KEYS))


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The same for a result that several queries read, such as a fit's errors."""
    return _once(spark, sf_dir, name, build, lambda table, path: table.write.parquet(path))


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cycle table."""
    return _stored(spark, sf_dir, "fleet", lambda: fleet_from_events(spark, sf_dir))


def fleet_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table, for the stages that start from one."""
    return _stored(spark, sf_dir, "features",
                   lambda: build_features(fleet(spark, sf_dir), KEYS, dense=True, keep_chunk=True))


def fleet_from_events(spark: SparkSession, sf_dir: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Cycle table over ``events`` in event order; cycle numbers are dense."""
    counted = running(events(spark, sf_dir), ["unit_id"], "event_id", dense=False, chunk_rows=chunk_rows,
                      sums={"_earlier": F.lit(1), "_used": F.col("value")})
    value, charged = F.col("value"), F.col("event_type") != "error"
    soh = F.round(1 - F.lit(1e-4) * (F.col("_used") + value), 6)
    return counted.select(
        "unit_id", (F.col("_earlier") + 1).alias("cycle_index"), F.col("event_id").alias("file_cycle_number"),
        F.col("ts").alias("cycle_start_time"),
        F.when((F.col("unit_id") % 7 == 0) & ~charged, 43.0).otherwise(24.0).alias("ambient_temperature"),
        (2 * soh).alias("capacity_ah"),
        (3000 + value).alias("discharge_duration_s"),
        (2.5 + value / 1000).alias("voltage_min"),
        (30 + value / 10).alias("temp_max"),
        F.when(charged, 10000 - value).alias("charge_duration_s"),
        F.when(charged, value / 10000).alias("charge_current_end"),
        F.when(charged, 25 + value / 20).alias("charge_temp_max"),
    )


def soh_of(cycles: DataFrame) -> DataFrame:
    return cycles.withColumn("soh", F.col("capacity_ah") / 2)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("unit_id").distinct()


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by last digit: 0-5 train, 6 val, 7 test."""
    digit = F.col("unit_id") % 10
    return units(spark, sf_dir).filter(digit < 8).select(
        "unit_id", F.when(digit < 6, "train").when(digit == 6, "val").otherwise("test").alias("split"))


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).filter(F.col("unit_id") % 10 >= 8).select(
        "unit_id", F.lit("last digit 8 or 9").alias("reason"))


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw entries with sample arrays (``schema.RAW_ENTRIES``), routed as in ``routed_entries``."""
    value, ts = F.col("value"), F.col("ts")
    kind = (
        F.when(F.col("event_type") == "click", "charge").when(F.col("event_type") == "purchase", "discharge")
        .when(F.col("event_type") == "error", "impedance").otherwise(F.col("event_type")))
    moment = F.array(*[f(ts).cast("double") for f in (F.year, F.month, F.day, F.hour, F.minute)],
                     F.extract(F.lit("SECOND"), ts).cast("double"))
    three = F.array(value, value / 2, F.lit(3.0))
    capacity = F.when(value > 2, F.array(F.when(value > 5, value / 1000 + 1).otherwise(0.0)))
    return events(spark, sf_dir).select(
        F.concat(F.lit("U"), F.col("unit_id").cast("string")).alias("battery_id"),
        F.col("event_id").cast("int").alias("file_cycle_number"), kind.alias("type"),
        F.lit(24.0).alias("ambient_temperature"), moment.alias("time"),
        F.struct(three.alias("voltage_measured"), three.alias("current_measured"), three.alias("temperature_measured"),
                 F.array(F.lit(0.0), value * 10).alias("time"), capacity.alias("capacity")).alias("data"))


def unit_of_folder(path: Column) -> Column:
    """The unit that a path ``.../unit=U7/name`` is named after."""
    return F.regexp_extract(path, r"unit=([^/]+)/[^/]+$", 1)


def land_unit_files(spark: SparkSession, sf_dir: str, root: str, landing: int) -> None:
    """A landing of nested files, one per unit, below ``root``: the first has even units whole and of the others every
    second event, the second has the odd units whole and of every fourth unit again every second event."""
    entries = raw_entries(spark, sf_dir)
    number = F.substring("battery_id", 2, 20).cast("bigint")
    whole = number % 2 == landing
    short = (F.col("file_cycle_number") % 2 == 0) & ((number % 2 == 1) if landing == 0 else (number % 4 == 0))
    entry = F.struct("file_cycle_number", *RAW_ENTRY.fieldNames())
    nested = entries.filter(whole | short).groupBy("battery_id").agg(F.array_sort(F.collect_list(entry)).alias("cycle"))
    write_unit_files(nested.select("battery_id", F.transform("cycle", lambda e: F.struct(
        *[e[n].alias(n) for n in RAW_ENTRY.fieldNames()])).alias("cycle")), f"{root}/landing{landing}")


def write_unit_files(nested: DataFrame, path: str) -> None:
    """One Parquet file per row, ``unit=<battery_id>/part-0.parquet``, written by the tasks with pyarrow: on a local disk without
    Hadoop's native library a file of Spark's own costs three processes that set permissions, most of its time. A file appears
    whole, under a name of its own, so a repeated task doubles none. Where pyarrow has no such file system, Spark writes them."""
    uri = _qualified(nested.sparkSession, path)
    try:
        FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError):
        nested.withColumn("unit", F.col("battery_id")).write.partitionBy("unit").parquet(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = FileSystem.from_uri(uri)
        n = 0
        for batch in batches:
            for i, unit in enumerate(batch.column("battery_id").to_pylist()):
                folder = f"{base}/unit={unit}"
                files.create_dir(folder)
                aside = f"{folder}/.{uuid.uuid4().hex}"
                pq.write_table(pa.Table.from_batches([batch.slice(i, 1)]), aside, filesystem=files, compression="none",
                               use_dictionary=False, store_schema=False)
                files.move(aside, f"{folder}/part-0.parquet")
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    nested.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    place = files.makeQualified(folder).toUri()
    return f"file://{place.getRawPath()}" if place.getScheme() == "file" else place.toString()


def routed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw entries: clicks charge, purchases discharge, errors are impedance runs.

    A purchase up to 2 has no capacity, one up to 5 a capacity of zero.
    """
    kind = (
        F.when(F.col("event_type") == "click", "charge").when(F.col("event_type") == "purchase", "discharge")
        .when(F.col("event_type") == "error", "impedance").otherwise(F.col("event_type")))
    capacity = F.when(F.col("value") <= 2, None).when(F.col("value") <= 5, 0.0).otherwise(
        F.col("value") / 1000 + 1)
    charge = F.col("type") == "charge"
    typed = events(spark, sf_dir).select(
        "unit_id", F.col("event_id").alias("file_cycle_number"), kind.alias("type"),
        capacity.alias("capacity_ah"), "value")
    return typed.select(
        "unit_id", "file_cycle_number", "capacity_ah", route(F.col("type"), F.col("capacity_ah")).alias("route"),
        F.when(charge, F.col("value") * 100).alias("charge_duration_s"),
        F.when(charge, F.col("value") / 1000).alias("charge_current_end"))
