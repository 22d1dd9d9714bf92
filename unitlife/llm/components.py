"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlife.llm.shared import stored


def _stars(edges: DataFrame, *, large: bool) -> DataFrame:
    """One star step over ``(a, b)`` with ``a > b``: neighbours are linked to the least node they can see."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("least")).select(
            F.col("a").alias("of"), F.least("a", "least").alias("least"))
        seen = near.join(least, F.col("a") == F.col("of")).filter(F.col("b") > F.col("a"))
        return seen.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "of")
    seen = edges.join(least, F.col("a") == F.col("of"))
    return (seen.select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionByName(least.select(F.col("of").alias("a"), F.col("least").alias("b")))
            .filter("a <> b").distinct())


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (``a``, ``b``) other than the roots; a root is the least node.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest
    path. Aggregates are map-side combined and the joins' hot sides can be split.
    """
    edges = stored(links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        edges = stored(_stars(_stars(edges, large=True), large=False), "stars")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
