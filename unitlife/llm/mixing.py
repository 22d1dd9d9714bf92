"""Operator 9: mix sources to target weights by hierarchical budgeting.

A token budget is split over a tree (domain, language, source) from the root down, among siblings in proportion to
their weights. No node gets more than the tokens below it times ``max_epochs``; what it cannot take goes to its
siblings, and a shortage leaves a family only when the whole family is full. A leaf then reads its documents in
seeded epochs, each in an order of its own, and keeps the prefix that reaches its budget: the document that crosses
the line is the last one.

Column functions only, in whole numbers. Budgets are one row per leaf. A leaf may hold any share of all rows: whole
epochs need no order, and a part of an epoch is cut into 4096 slices of the seeded order; slice totals show where
the line falls, and only the rows of that slice are put in order.

A null text has no tokens, and documents without tokens are never taken; a null level is a node of its own. A weight of
0 leaves a node and all below it out; its siblings take what it would have got, as far as they can.
Repeated rows are taken one by one. An empty table, or a budget of 0, gives an empty result. Other columns pass
through; input columns called ``epoch`` or ``tokens`` are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitlife.llm.shared import positional, stored

SLICE_DIGITS = 3  # hexadecimal


def byte_tokens(text: Column) -> Column:
    """Four bytes a token."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("bigint")


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys``, null equal to null; the keys come from ``left``."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    return left.join(right, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))).drop(
        *(f"_{k}" for k in keys))


def _split(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """``nodes`` (``weight``, ``capacity``, the parent's ``given``, ``name``) with their ``budget``.

    In the order of capacity per weight, siblings are full as long as their share of what is left covers their
    capacity; the others share the rest by weight. Tokens left over by the division go to the first of them.
    """
    family = Window.partitionBy(*(parent or [F.lit(0)]))
    line = family.orderBy(F.col("capacity") / F.greatest("weight", F.lit(1)), F.col("name"))
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    ranked = nodes.withColumns({
        "left": F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0)),
        "weight_left": F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    }).withColumn("full", F.col("capacity").cast("decimal(19,0)") * F.col("weight_left").cast("decimal(19,0)")
                  <= F.col("left").cast("decimal(19,0)") * F.col("weight").cast("decimal(19,0)"))
    shared = ranked.withColumns({
        "rest": F.col("given") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(family),
        "weight_open": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(family),
        "nth": F.sum(F.when(F.col("full"), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0)),
    }).withColumn("part", F.when(F.col("full"), F.col("capacity")).otherwise(
        F.expr("(cast(rest as decimal(19,0)) * cast(weight as decimal(19,0))) div weight_open")))
    over = F.col("given") - F.sum("part").over(family)
    return shared.withColumn("over", over).withColumn(
        "budget", F.col("part") + F.when(~F.col("full") & (F.col("nth") <= F.col("over")), 1).otherwise(0))


def budgets(totals: DataFrame, levels: Sequence[str], share: tuple[int, int],
            weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """``totals`` (levels, ``tokens``) with each leaf's ``budget``; ``share`` of all tokens is given out."""
    all_rows = Window.partitionBy(F.lit(0))
    weight_of = {level: reduce(lambda w, known: F.when(F.col(level) == known[0], known[1]).otherwise(w),  # noqa: B023
                               weights.get(level, {}).items(), F.lit(1)) for level in levels}
    taken = reduce(and_, (w > 0 for w in weight_of.values()))
    out = totals.filter(F.col("tokens") > 0).withColumn("capacity", F.when(taken, F.col("tokens") * max_epochs).otherwise(0))
    asked = F.sum("tokens").over(all_rows) * share[0]
    out = out.withColumn("_all", asked).withColumn("given", F.least(
        F.expr(f"_all div {share[1]}"), F.sum("capacity").over(all_rows))).drop("_all")
    for depth, level in enumerate(levels):
        path = list(levels[:depth + 1])
        nodes = (
            out.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.max("given").alias("given"))
            .withColumns({"weight": weight_of[level].cast("bigint"), "name": F.coalesce(F.col(level), F.lit(""))})
        )
        split = _split(nodes, path[:-1]).select(*path, F.col("budget").alias("given"))
        out = _join(out.drop("given"), split, path)
    return out.select(*levels, F.col("tokens").alias("leaf_tokens"), F.col("given").alias("budget"))


def mix(df: DataFrame, levels: Sequence[str], share: tuple[int, int] = (1, 1),
        weights: Mapping[str, Mapping[str, int]] | None = None, max_epochs: int = 2, seed: int = 0,
        key: str = "doc_id", text: str = "text") -> DataFrame:
    """The chosen documents: ``df`` with ``epoch`` and ``tokens``, one row for every epoch that takes a document.

    ``levels`` names the tree's columns from the root down, ``share`` is the budget as a fraction of all tokens,
    ``weights`` maps a level to whole-number weights of its values (others weigh 1).
    """
    own = [c for c in df.columns if c not in ("epoch", "tokens")]
    flat = positional(df.select(*own))
    kept, place_of = flat.columns, dict(zip(own, flat.columns, strict=True))
    key, text = place_of[key], place_of[text]
    names = [f"level{i}" for i in range(len(levels))]
    rows = flat.select(*kept, byte_tokens(F.col(text)).alias("tokens"),
                       *(F.col(place_of[c]).cast("string").alias(n) for c, n in zip(levels, names, strict=True)))
    leaves = stored(budgets(
        rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")), names, share,
        {n: (weights or {}).get(c, {}) for c, n in zip(levels, names, strict=True)}, max_epochs,
    ), "mix-leaves")

    whole, rest = F.expr("budget div leaf_tokens"), F.expr("budget % leaf_tokens")
    seeded = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"),
                               F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("tokens").cast("string")))

    def partial(given: DataFrame) -> DataFrame:
        """Rows of leaves whose last epoch is a part of one, with their place in its order."""
        return (
            _join(rows.filter(F.col("tokens") > 0), given, names)
            .withColumn("epoch", whole).withColumn("place", seeded)
            .withColumn("slice", F.substring("place", 1, SLICE_DIGITS))
        )

    started = leaves.filter(rest > 0)
    upto = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    line = stored(
        partial(started).groupBy(*names, "slice")
        .agg(F.sum("tokens").alias("total"), F.max(rest).alias("rest"),
             F.max("budget").alias("budget"), F.max("leaf_tokens").alias("leaf_tokens"))
        .withColumn("upto", F.sum("total").over(upto))
        .filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("total") < F.col("rest")))
        .select(*names, "budget", "leaf_tokens", F.col("slice").alias("line"), (F.col("rest") - F.col("upto") + F.col("total")).alias("room")),
        "mix-line")
    near = partial(line).filter(F.col("slice") <= F.col("line"))
    in_slice = Window.partitionBy(*names).orderBy("place", F.md5(text)).rowsBetween(Window.unboundedPreceding, -1)
    crossing = (
        near.filter(F.col("slice") == F.col("line"))
        .withColumn("before", F.coalesce(F.sum("tokens").over(in_slice), F.lit(0)))
        .filter(F.col("before") < F.col("room"))
    )
    epochs = (
        _join(rows.filter(F.col("tokens") > 0), leaves.filter(whole > 0), names)
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)))
    )
    columns = [*kept, "epoch", "tokens"]
    return (epochs.select(*columns)
            .unionByName(near.filter(F.col("slice") < F.col("line")).select(*columns))
            .unionByName(crossing.select(*columns))).toDF(*own, "epoch", "tokens")
