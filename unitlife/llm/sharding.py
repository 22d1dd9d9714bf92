"""Operator 5: reproducible shuffle of all rows into shards.

Every row gets a global number, a Feistel network permutes the numbers, and the permuted number
says shard and slot. Only column functions run, and no task sees more than its share:

* The row number does not depend on files, partitions or cluster size. A row's bucket is the low
  bits of a hash over all its columns; bucket sizes become offsets (one row per bucket, a fixed
  number), and rows are numbered inside their bucket in hash order.
* Equal rows are counted before they are shuffled, and large counts are unfolded piece by piece.
* The network works on ``Z_a x Z_b`` with ``a * b`` barely above the row count. Numbers that fall
  outside walk on along their cycle. A walk has at most ``a * b - rows`` outside stops, so a walk of
  that fixed length is exact.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitlife.llm.shared import positional

BUCKETS = 4096
PIECE = 1 << 16
ROUNDS = 8
SIDES_TRIED = 1 << 14


def sides(rows: int) -> tuple[int, int]:
    """``a, b`` with the least ``a * b >= rows`` among near-square pairs."""
    if rows < 4:
        return 1, max(rows, 1)
    top = isqrt(rows)
    bottom = max(2, top // 2, top - SIDES_TRIED)
    a = min(range(top, bottom - 1, -1), key=lambda a: -rows % a)
    return a, -(-rows // a)


def _noise(half: Column, i: Column, seed: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed).cast("bigint"), i, half), F.lit(modulus).cast("bigint"))


def _rounds(number: Column, rows: int, seed: int, *, inverse: bool) -> Column:
    a, b = sides(rows)
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    sign = -1 if inverse else 1

    def turn(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + sign * _noise(s["r"], i, seed, a), F.lit(a).cast("bigint"))
        right = F.pmod(s["r"] + sign * _noise(s["l"], i, seed, b), F.lit(b).cast("bigint"))
        return F.when(i % 2 == 0, F.struct(left.alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), right.alias("r")))

    start = F.struct(F.floor(number / F.lit(b)).cast("bigint").alias("l"),
                     F.pmod(number, F.lit(b).cast("bigint")).alias("r"))
    return F.aggregate(F.array(*(F.lit(i) for i in order)), start, turn, lambda s: s["l"] * b + s["r"])


def permuted(number: Column, rows: int, seed: int = 0, *, inverse: bool = False) -> Column:
    """The place of row ``number`` in a permutation of ``0 .. rows - 1`` (or, inverse, the row at a place)."""
    a, b = sides(rows)
    outside = a * b - rows
    at = _rounds(number, rows, seed, inverse=inverse)
    if not outside:
        return at
    steps = F.array_repeat(F.lit(0), outside)
    return F.aggregate(steps, at, lambda p, _: F.when(p < rows, p).otherwise(
        _rounds(p, rows, seed, inverse=inverse)))


def locate(number: Column, rows: int, shards: int, seed: int = 0) -> tuple[Column, Column]:
    """Shard and slot of row ``number``, without touching the other rows."""
    place = permuted(number, rows, seed)
    return F.pmod(place, F.lit(shards)).cast("int"), F.floor(place / F.lit(shards)).cast("bigint")


def row_at(shard: Column, slot: Column, rows: int, shards: int, seed: int = 0) -> Column:
    """The row number found at a shard's slot."""
    return permuted(slot.cast("bigint") * shards + shard, rows, seed, inverse=True)


def numbered(df: DataFrame, name: str = "row_number", buckets: int = BUCKETS, piece: int = PIECE) -> DataFrame:
    """``df`` with gapless numbers from 0 that depend on the rows alone.

    Rows equal in every column are interchangeable and get neighbouring numbers. An input column
    called ``name`` is replaced. Columns must be of types that Spark can group by.
    """
    names = df.columns
    flat = positional(df)
    cols = flat.columns
    groups = (
        flat.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("h", F.xxhash64(*cols)).withColumn("g", F.xxhash64(F.lit(1), *cols))
        .withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))
    )
    offsets = (
        groups.groupBy("bucket").agg(F.sum("n").alias("size"))
        .select("bucket", (F.sum("size").over(Window.orderBy("bucket")) - F.col("size")).alias("base"))
    )
    inside = Window.partitionBy("bucket").orderBy("h", "g").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        groups.withColumn("upto", F.sum("n").over(inside))
        .join(F.broadcast(offsets), "bucket")  # one row per bucket
        .withColumn("first", F.col("base") + F.col("upto") - F.col("n"))
        .select(*cols, "n", "first")
    )
    few = placed.filter(F.col("n") <= piece)
    many = (
        placed.filter(F.col("n") > piece)
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / piece))))
        .withColumn("first", F.col("first") + F.col("k") * piece)
        .withColumn("n", F.least(F.lit(piece), F.col("n") - F.col("k") * piece))
        .repartition("first")
        .select(*cols, "n", "first")
    )
    unfolded = few.union(many).select(
        *cols, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("number"))
    kept = [(c, n) for c, n in zip(cols, names, strict=True) if n != name]
    return unfolded.select(*(F.col(c).alias(n) for c, n in kept), F.col("number").alias(name))


def shard(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``row_number``, ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0).

    Shard sizes differ by one row at most. Null, empty or very long values are ordinary values;
    repeated rows each get a place of their own; an empty table stays empty; input columns with
    the names of the new ones are replaced.
    """
    rows = df.count()
    placed = numbered(df)
    to_shard, to_slot = locate(F.col("row_number"), rows, shards, seed)
    others = [c for c in placed.columns if c not in ("shard", "slot")]
    return placed.select(*others, to_shard.alias("shard"), to_slot.alias("slot"))
