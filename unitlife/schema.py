"""Column names, table schemas and the constants that are part of the semantics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Keys:
    """Names of the unit column and of the per-unit cycle number."""

    unit: str = "battery_id"
    cycle: str = "cycle_index"


class DataValidationError(Exception):
    """A table breaks an invariant: ``rule`` by ``rows`` rows."""

    def __init__(self, message: str, rule: str | None = None, rows: int = 0):
        super().__init__(message)
        self.rule, self.rows = rule, rows


class UnitsError(Exception):
    """Some units break a rule; ``units`` is the complete table of them."""

    def __init__(self, message: str, units=None):
        super().__init__(message)
        self.units = units


class SplitLeakageError(UnitsError, AssertionError):
    """A unit is in more than one split."""


class UnknownUnitsError(UnitsError, KeyError):
    """A unit has neither a split nor a documented exclusion."""

    __str__ = Exception.__str__


# Fixed values.
CAPACITY_RANGE_AH = (0.0, 3.2)
RATED_CAPACITY_AH = 2.0
ROLLING_WINDOW = 5
SLOPE_WINDOW = 5
MIN_ROLLING_OBSERVATIONS = 2
HORIZONS = (1, 10, 25, 50)
HORIZON_GRID = tuple(range(1, 122, 5))
EOL_THRESHOLDS = (0.70, 0.80)
MIN_HISTORY_CYCLES = 10
MIN_GRID_ROWS = 50
R2_TRIPWIRE = 0.95
STANDING_FRACTIONS = (0.25, 0.50, 0.75)
PROJECTION_MARGIN = 25

SAMPLES = T.ArrayType(T.DoubleType())

RAW_ENTRY = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("ambient_temperature", T.DoubleType()),
    T.StructField("time", SAMPLES),
    T.StructField("data", T.StructType([
        T.StructField("voltage_measured", SAMPLES),
        T.StructField("current_measured", SAMPLES),
        T.StructField("temperature_measured", SAMPLES),
        T.StructField("time", SAMPLES),
        T.StructField("capacity", SAMPLES),
    ])),
])

# One row per unit file, its cycle entries in file order.
RAW_FILE = T.StructType([
    T.StructField("battery_id", T.StringType()),
    T.StructField("cycle", T.ArrayType(RAW_ENTRY)),
])

# One row per cycle entry; what the landing scan hands to the ingest.
RAW_ENTRIES = T.StructType([
    T.StructField("battery_id", T.StringType()),
    T.StructField("file_cycle_number", T.IntegerType()),
    *RAW_ENTRY.fields,
])

CHARGE_COLUMNS = ("charge_duration_s", "charge_current_end", "charge_temp_max", "charge_temp_mean")
DISCHARGE_COLUMNS = (
    "discharge_duration_s", "voltage_min", "voltage_mean", "current_mean", "temp_max", "temp_mean",
)

CYCLES = T.StructType([
    T.StructField("battery_id", T.StringType()),
    T.StructField("file_cycle_number", T.IntegerType()),
    T.StructField("cycle_start_time", T.TimestampNTZType()),
    T.StructField("ambient_temperature", T.DoubleType()),
    T.StructField("capacity_ah", T.DoubleType()),
    *[T.StructField(c, T.DoubleType()) for c in DISCHARGE_COLUMNS + CHARGE_COLUMNS],
    T.StructField("cycle_index", T.IntegerType()),
])

DERIVED_COLUMNS = (
    "soh", "soh_prev", "soh_roll_mean", "soh_roll_std", "fade_rate",
    "discharge_duration_prev", "voltage_min_prev", "temp_max_prev", "time_since_prev_cycle_h",
)

FEATURES = T.StructType([
    *CYCLES.fields, *[T.StructField(c, T.DoubleType()) for c in DERIVED_COLUMNS],
])


def null_if_nan(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means "missing" in the inputs; every operator expects NULL for that."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: null_if_nan(F.col(c)) for c in floats}) if floats else df


def require_columns(df: DataFrame, names) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise KeyError(f"missing column(s): {missing}")
