"""Fleet data-quality audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlife.schema import Keys

# Audit limits, and the flag texts in the order they are reported.
MAX_PLAUSIBLE_SOH = 1.005
EOL_SOH = 0.70
NEAR_ZERO_SOH = 0.2
SHORT_RUN_CYCLES = 30
FLAG_IMPOSSIBLE = "SoH > 1 (impossible)"
FLAG_BELOW_EOL = "below EOL at first cycle"
FLAG_NEAR_ZERO = "near-zero capacity runs"
FLAG_AMBIENT = "ambient changes mid-experiment"
FLAG_SHORT = "very short run"
HOT_AMBIENT = 30.0


def ambient_settings(df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Every distinct ambient temperature of every unit, with its cycle count."""
    return df.groupBy(keys.unit, "ambient_temperature").agg(F.count("*").alias("n"))


def fleet_audit(df: DataFrame, keys: Keys = Keys(), digits: int = 3) -> DataFrame:
    """One row per unit: size, first/last/lowest/highest health, number of ambient settings, flags.

    Aggregated to (unit, ambient) first, then to the unit, so a large unit is combined map-side
    twice. The settings themselves, any number of them, are the rows of ``ambient_settings``. Flags are
    judged on the rounded values.
    """
    cycle, seen = F.col(keys.cycle), F.col("soh").isNotNull()
    parts = df.groupBy(keys.unit, "ambient_temperature").agg(
        F.count("*").alias("n"),
        F.min(F.when(seen, cycle)).alias("_first"), F.max(F.when(seen, cycle)).alias("_last"),
        F.min_by("soh", F.when(seen, cycle)).alias("_soh_first"),
        F.max_by("soh", F.when(seen, cycle)).alias("_soh_last"),
        F.min("soh").alias("soh_min"), F.max("soh").alias("soh_max"))
    rounded = lambda c, name: F.bround(c, digits).alias(name)
    units = parts.groupBy(keys.unit).agg(
        F.sum("n").alias("n"),
        rounded(F.min_by("_soh_first", "_first"), "soh_first"),
        rounded(F.max_by("_soh_last", "_last"), "soh_last"),
        rounded(F.min("soh_min"), "soh_min"), rounded(F.max("soh_max"), "soh_max"),
        F.count("*").alias("n_ambients"))
    flags = F.concat_ws(
        "; ",
        F.when(F.col("soh_max") > MAX_PLAUSIBLE_SOH, FLAG_IMPOSSIBLE),
        F.when(F.col("soh_first") < EOL_SOH, FLAG_BELOW_EOL),
        F.when(F.col("soh_min") < NEAR_ZERO_SOH, FLAG_NEAR_ZERO),
        F.when(F.col("n_ambients") > 1, FLAG_AMBIENT),
        F.when(F.col("n") < SHORT_RUN_CYCLES, FLAG_SHORT))
    return units.withColumn("flags", flags)


def classify_runs(df: DataFrame, keys: Keys = Keys(), units: Sequence | None = None,
                  limit: float = NEAR_ZERO_SOH) -> DataFrame:
    """``aborted`` for near-zero health, else ``complete``; with the voltage to tell why."""
    chosen = df.filter(F.col(keys.unit).isin(list(units))) if units is not None else df
    return chosen.select(
        keys.unit, keys.cycle, "soh", "voltage_min",
        F.when(F.col("soh") < limit, "aborted").when(F.col("soh") >= limit, "complete").alias("run"))


def aborted_runs(classified: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Aborted runs per unit; units without any do not appear."""
    return classified.filter(F.col("run") == "aborted").groupBy(keys.unit).agg(
        F.count("*").alias("n_aborted"))


def hot_cycles(df: DataFrame, limit: float = HOT_AMBIENT) -> DataFrame:
    return df.filter(F.col("ambient_temperature") > limit)


def fleet_size(df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Rows and distinct units."""
    return df.groupBy(keys.unit).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_units"))
