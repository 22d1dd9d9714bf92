"""Date vectors and time gaps, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def datevec_to_timestamp(vec: Column) -> Column:
    """``[y, m, d, H, M, S.frac]`` to TIMESTAMP_NTZ; seconds are added, so 60 and more roll over."""
    whole = [F.get(vec, i).cast("int") for i in range(5)]
    start = F.make_timestamp_ntz(*whole, F.lit(0))
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.get(vec, 5).cast("decimal(18,6)"))
    return F.when(
        F.size(vec) < 6, F.raise_error(F.lit("expected a 6-element datevec")).cast("timestamp_ntz")
    ).otherwise(start + seconds)


def hours_between(earlier: Column, later: Column) -> Column:
    """Elapsed hours with fractional seconds, for TIMESTAMP_NTZ or TIMESTAMP."""
    gap = later - earlier
    minutes = ((F.extract(F.lit("DAY"), gap).cast("bigint") * 24 + F.extract(F.lit("HOUR"), gap)) * 60
               + F.extract(F.lit("MINUTE"), gap))
    seconds = F.extract(F.lit("SECOND"), gap).cast("double")
    return (minutes * 60 + seconds) / 3600.0


def file_stem(path: Column) -> Column:
    """Last path component without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(.)\.[^.]*$", "$1")
