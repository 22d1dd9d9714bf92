"""What the operators of this subpackage share: tables, scratch paths and safe column names."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

from unitlife.session import shared_folder


LONG_TEXT = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a new table in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there: its lineage ends, and a lost
    executor costs a re-read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positional(df: DataFrame) -> DataFrame:
    """``df`` with columns ``c0, c1, ...``, so that working columns cannot clash with the caller's."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def values(column) -> Iterator:
    """The values of an Arrow column, one at a time: a batch of long texts need not be held twice."""
    return (x.as_py() for x in column)


def words_of(pattern: re.Pattern, text: str) -> Iterable[str]:
    """The words of a text; of a long one, one at a time."""
    return pattern.findall(text) if len(text) < LONG_TEXT else (m[0] for m in pattern.finditer(text))


def batched(rows: Iterator, weight, limit: int) -> Iterator[Sequence]:
    """Consecutive rows whose weights sum to at most ``limit`` (a heavier row comes alone)."""
    held, total = [], 0
    for row in rows:
        w = weight(row)
        if held and total + w > limit:
            yield held
            held, total = [], 0
        held.append(row)
        total += w
    if held:
        yield held
