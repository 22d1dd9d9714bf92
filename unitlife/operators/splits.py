"""Whole-unit train/val/test assignment."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlife.operators.ordered import CHUNK, CHUNK_ROWS, ensure_chunk, join_on_units
from unitlife.schema import Keys, SplitLeakageError, UnitsError, UnknownUnitsError

SPLITS = ("train", "val", "test")

# The default cohort, and the units left out of it.
TRAIN_UNITS = ("B0005", "B0006", "B0025", "B0026", "B0027", "B0028", "B0029", "B0030", "B0031", "B0032")
VAL_UNITS = ("B0007",)
TEST_UNITS = ("B0018",)
EXCLUDED_UNITS = (
    "B0033", "B0034", "B0036", "B0038", "B0039", "B0040", "B0041", "B0042", "B0043", "B0044", "B0045", "B0046", "B0047",
    "B0048", "B0049", "B0050", "B0051", "B0052", "B0053", "B0054", "B0055", "B0056")
SPLIT_OF: dict[str, str] = {
    **{u: "train" for u in TRAIN_UNITS}, **{u: "val" for u in VAL_UNITS}, **{u: "test" for u in TEST_UNITS},
}

UnitTable = DataFrame | Mapping[str, str]
UnitList = DataFrame | Iterable[str]
# A mapping of at most this many units is broadcast; a few megabytes.
BROADCAST_UNITS = 100_000


def unit_table(df: DataFrame, table: UnitTable, keys: Keys, value: str) -> DataFrame:
    if isinstance(table, DataFrame):
        return table
    kind = df.schema[keys.unit].dataType.simpleString()
    return df.sparkSession.createDataFrame(list(table.items()), f"`{keys.unit}` {kind}, {value} string")


def unit_list(df: DataFrame, units: UnitList, keys: Keys) -> DataFrame:
    """Units as a table; of a mapping, its keys."""
    if isinstance(units, DataFrame):
        return units.select(keys.unit)
    kind = df.schema[keys.unit].dataType.simpleString()
    return df.sparkSession.createDataFrame([(u,) for u in units], f"`{keys.unit}` {kind}")


def units_of(df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    return df.select(keys.unit).distinct()


def unknown_units(df: DataFrame, cohort: DataFrame, excluded: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Units of ``df`` with neither a split nor a documented exclusion."""
    known = cohort.select(keys.unit).unionByName(excluded.select(keys.unit))
    return units_of(df, keys).join(known, keys.unit, "left_anti")


def excluded_present(df: DataFrame, excluded: DataFrame, keys: Keys = Keys()) -> DataFrame:
    return units_of(df, keys).join(excluded.select(keys.unit), keys.unit, "left_semi")


def leaked_units(assigned: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Units that carry more than one split label."""
    return (
        assigned.groupBy(keys.unit)
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .filter(F.col("first_split") != F.col("last_split"))
    )


def _offending(found: DataFrame, keys: Keys, error: type[UnitsError], what: str) -> None:
    """Raise ``error`` with the complete table of units, if there are any; the message has their number and range."""
    total, first, last = found.agg(F.count("*"), F.min(keys.unit), F.max(keys.unit)).first()
    if total:
        named = f"{first}" if total == 1 else f"{first} to {last}"
        raise error(f"{total} unit(s) {what}: {named}", found)


def assert_no_unit_overlap(assigned: DataFrame, keys: Keys = Keys()) -> None:
    _offending(leaked_units(assigned, keys), keys, SplitLeakageError, "in more than one split")


def assert_known_units(df: DataFrame, cohort: DataFrame, excluded: DataFrame, keys: Keys = Keys()) -> None:
    _offending(unknown_units(df, cohort, excluded, keys), keys, UnknownUnitsError, "without split or documented exclusion")


def assign_splits(df: DataFrame, cohort: UnitTable = SPLIT_OF, excluded: UnitList = EXCLUDED_UNITS,
                  keys: Keys = Keys(), *, check: bool = True, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``split`` and drop excluded units.

    ``check`` runs the unknown-unit and the leakage assertion first, each one narrow aggregate.
    A mapping of up to ``BROADCAST_UNITS`` units is broadcast; anything else is joined at
    (unit, chunk) grain, where a unit with very many rows is spread out.
    """
    small = not isinstance(cohort, DataFrame) and len(cohort) <= BROADCAST_UNITS
    cohort = unit_table(df, cohort, keys, "split").select(keys.unit, "split")
    if check:
        assert_known_units(df, cohort, unit_list(df, excluded, keys), keys)
        assert_no_unit_overlap(cohort.join(units_of(df, keys), keys.unit, "left_semi"), keys)
    if small:
        return df.join(F.broadcast(cohort), keys.unit)
    had_chunk = CHUNK in df.columns
    joined = join_on_units(ensure_chunk(df, keys.cycle, chunk_rows), cohort, [keys.unit])
    return joined if had_chunk else joined.drop(CHUNK)


def split_frames(assigned: DataFrame) -> dict[str, DataFrame]:
    return {name: assigned.filter(F.col("split") == name) for name in SPLITS}


def split_units(assigned: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Rows per split and unit."""
    return assigned.groupBy("split", keys.unit).agg(F.count("*").alias("n_rows"))


def split_sizes(assigned: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Rows and units per split, from the pre-aggregated unit counts."""
    return split_units(assigned, keys).groupBy("split").agg(
        F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_units"))


def cohort_mismatch(df: DataFrame, cohort: DataFrame, excluded: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Units on one side only of ``fleet == cohort + excluded``; empty when they agree."""
    fleet = units_of(df, keys)
    decided = cohort.select(keys.unit).union(excluded.select(keys.unit)).distinct()
    return (
        fleet.exceptAll(decided).select(keys.unit, F.lit("undecided").alias("side"))
        .unionByName(decided.exceptAll(fleet).select(keys.unit, F.lit("not in fleet").alias("side")))
    )


def cohort_problems(cohort: DataFrame, excluded: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Units both admitted and excluded, split labels other than the three, and splits without a unit (NULL)."""
    both = cohort.join(excluded.select(keys.unit).distinct(), keys.unit, "left_semi").select(
        keys.unit, F.lit("admitted and excluded").alias("problem"))
    odd = cohort.filter(~F.col("split").isin(*SPLITS)).select(
        keys.unit, F.lit("unknown split label").alias("problem"))
    kind = cohort.schema[keys.unit].dataType
    labels = cohort.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    missing = labels.join(cohort, "split", "left_anti").select(
        F.lit(None).cast(kind).alias(keys.unit), F.concat(F.lit("no unit in split "), "split").alias("problem"))
    return both.unionByName(odd).unionByName(missing)
