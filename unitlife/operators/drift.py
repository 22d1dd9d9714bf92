"""Population stability index (PSI) between a reference sample and current samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from unitlife.functions.life import psi_term, rate_psi
from unitlife.operators.quantiles import (
    FEW_GROUPS_ROWS, LISTED_ROWS, column_order, column_ranks, interpolated, linspace_probabilities,
)
from unitlife.schema import null_if_nan

# Fixed values.
DEFAULT_BINS = 10
CONSTANT_BAND_REL = 1e-6

NO_DATA = "no data"
EMPTY_SIDE = "PSI requires non-empty samples on both sides"


def long_form(df: DataFrame, features: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """``ids..., feature, x``, NULL for a missing value (kept: an all-missing feature must show)."""
    values = df.select(*ids, *[null_if_nan(F.col(f).cast("double")).alias(f) for f in features])
    return values.unpivot(list(ids), list(features), "feature", "x")


def column_quantiles(df: DataFrame, features: Sequence[str], probabilities: Sequence[float], limit: int = FEW_GROUPS_ROWS,
                     also: Sequence[Callable[[str], Column]] = (), at_most: int | None = None) -> list[Row]:
    """``feature, n, quantiles`` and what ``also`` computes from each column, as local rows; exact at any size.

    One wide pass counts (and computes ``also``). As many columns as have up to ``limit`` values together share a second one; the others
    are narrowed by ``column_order``. Nothing is unpivoted or shuffled but counts. ``at_most`` is a known bound on the rows: if all
    columns are within ``limit``, one pass does it all.
    """
    wide = df.select([null_if_nan(F.col(f).cast("double")).alias(f"x{i}") for i, f in enumerate(features)])
    share = F.array(*[F.lit(float(p)) for p in probabilities])
    at_once = at_most is not None and at_most * len(features) <= limit
    counted = wide.agg(*[
        F.struct(F.count(f"x{i}").alias("n"), F.min(f"x{i}").alias("lo"), F.max(f"x{i}").alias("hi"),
                 *[make(f"x{i}").alias(f"v{k}") for k, make in enumerate(also)],
                 *([F.percentile(f"x{i}", share).alias("q")] if at_once else [])).alias(f"x{i}")
        for i in range(len(features))]).first()
    others = [tuple(counted[i])[3:3 + len(also)] for i in range(len(features))]
    if at_once:
        return [Row(feature=f, n=counted[i]["n"], quantiles=counted[i]["q"], also=others[i]) for i, f in enumerate(features)]
    small, total = [], 0
    for i in sorted(range(len(features)), key=lambda i: counted[i]["n"]):
        total += counted[i]["n"]
        if total <= limit:
            small.append(i)
    found = wide.agg(*[F.percentile(f"x{i}", share).alias(f"x{i}") for i in small]).first().asDict() if small else {}
    if large := [i for i in range(len(features)) if i not in small]:
        order = column_order(wide, [f"x{i}" for i in large], [(counted[i]["lo"], counted[i]["hi"]) for i in large],
                             column_ranks(probabilities), listed=min(limit, LISTED_ROWS))
        found |= {f"x{i}": interpolated(*order[k, 0], probabilities) for k, i in enumerate(large)}
    return [Row(feature=f, n=counted[i]["n"], quantiles=found[f"x{i}"], also=others[i]) for i, f in enumerate(features)]


def inner_edges(quantiles: Sequence[float]) -> list[float]:
    """Distinct quantiles without the outer two; a tight band where fewer than three remain.

    The outer bins are open-ended. A constant (or two-valued) reference gets three bins: below,
    inside and above a band around its first edge.
    """
    edges = sorted(set(quantiles))
    if len(edges) >= 3:
        return edges[1:-1]
    band = max(abs(edges[0]), 1.0) * CONSTANT_BAND_REL
    return [edges[0] - band, edges[0] + band]


def _rounded(spark: SparkSession, rows: list[Row], digits: int) -> list[list[float] | None]:
    """Quantiles rounded by Spark's own rule."""
    frame = spark.createDataFrame([(i, r.quantiles) for i, r in enumerate(rows)], "i int, q array<double>")
    cut = frame.select("i", F.transform("q", lambda v: F.round(v, digits)).alias("q")).collect()
    return [q for _, q in sorted((r["i"], r["q"]) for r in cut)]


@dataclass(frozen=True)
class Fitted:
    """A feature's edges, fixed by the reference, and the reference counts."""

    feature: str
    edges: list[float]
    n: int = 0
    cells: tuple[int, ...] = ()


def fit_edges(reference: DataFrame, features: Sequence[str], bins: int = DEFAULT_BINS, *, digits: int | None = None,
              limit: int = FEW_GROUPS_ROWS) -> list[Fitted]:
    """Edges per feature as local values, so that later passes compare with literals. A feature that the reference
    never reports has none. ``digits`` rounds the quantiles, for comparing engines whose interpolation differs in
    the last bits."""
    rows = column_quantiles(reference, features, linspace_probabilities(bins), limit)
    quantiles = [r.quantiles for r in rows]
    if digits is not None:
        quantiles = _rounded(reference.sparkSession, rows, digits)
    return [Fitted(r.feature, inner_edges(q) if r.n else [], r.n) for r, q in zip(rows, quantiles, strict=True)]


def fit_reference(reference: DataFrame, features: Sequence[str], bins: int = DEFAULT_BINS, *,
                  digits: int | None = None, limit: int = FEW_GROUPS_ROWS) -> list[Fitted]:
    """Edges and reference counts. The reference's columns are kept while they are read: counts, quantiles and bins."""
    kept = reference.select(*features).persist()
    try:
        fitted = fit_edges(kept, features, bins, digits=digits, limit=limit)
        rows = {r["feature"]: r for r in histogram(kept, fitted, (), bins).collect()}
    finally:
        kept.unpersist()
    return [Fitted(f.feature, f.edges, f.n, tuple(rows[f.feature][c] for c in _cells(bins))) for f in fitted]


def reference_edges(reference: DataFrame, features: Sequence[str], bins: int = DEFAULT_BINS, **options) -> DataFrame:
    """``feature, n, edges``: one row per feature."""
    fitted = fit_edges(reference, features, bins, **options)
    return reference.sparkSession.createDataFrame(
        [(f.feature, f.n, f.edges) for f in fitted], "feature string, n bigint, edges array<double>")


def _cells(bins: int) -> list[str]:
    return [f"c{i}" for i in range(max(bins, 3))]


def _bin_of(x: Column, edges: Sequence[float], first: int = 0) -> Column:
    """The number of edges at or below ``x``, by a tree of comparisons."""
    if not edges:
        return F.lit(first)
    middle = len(edges) // 2
    return F.when(x < F.lit(edges[middle]), _bin_of(x, edges[:middle], first)).otherwise(
        _bin_of(x, edges[middle + 1:], first + middle + 1))


def histogram(df: DataFrame, fitted: Sequence[Fitted], by: Sequence[str] = (), bins: int = DEFAULT_BINS) -> DataFrame:
    """``by..., feature, n, c0, c1, ...`` of the wide rows ``df``.

    Bins are half-open: a value on an edge belongs to the right one. Every value gets its bin's number by a tree of
    comparisons; one map-side combined count by (group, feature, bin) follows, whose rows are as many as bins are in use, and
    the counts are set side by side. A missing value counts in a bin of its own, so that no feature of a group can go missing.
    """
    cells = _cells(bins)
    missing = len(cells)
    codes = []
    for i, f in enumerate(fitted):
        x = null_if_nan(F.col(f.feature).cast("double"))
        codes.append(F.when(x.isNull(), missing).otherwise(_bin_of(x, f.edges)) + i * (missing + 1))
    coded = df.select(*by, F.explode(F.array(*codes)).alias("_code"))
    counted = coded.groupBy(*by, "_code").agg(F.count(F.lit(1)).alias("_n"))
    place, names = F.expr(f"_code % {missing + 1}"), F.array(*[F.lit(f.feature) for f in fitted])
    in_bin = [F.sum(F.when(place == k, F.col("_n")).otherwise(0)).alias(c) for k, c in enumerate(cells)]
    wide = counted.groupBy(*by, F.get(names, F.expr(f"_code div {missing + 1}").cast("int")).alias("feature")).agg(
        F.sum(F.when(place != missing, F.col("_n")).otherwise(0)).alias("n"), *in_bin)
    if by:
        return wide
    # without rows there is no group, but every feature has its zeros
    zeros = df.sparkSession.createDataFrame([(f.feature,) for f in fitted], "feature string")
    return zeros.join(F.broadcast(wide), "feature", "left").select(
        "feature", *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("n", *cells)])


def expected_counts(spark: SparkSession, fitted: Sequence[Fitted], bins: int = DEFAULT_BINS) -> DataFrame:
    """The reference's histogram as a table, one row per feature."""
    cells = ", ".join(f"{c} bigint" for c in _cells(bins))
    return spark.createDataFrame([(f.feature, f.n, *f.cells) for f in fitted], f"feature string, n bigint, {cells}")


def psi_from_histograms(current: DataFrame, reference: DataFrame, by: Sequence[str] = (),
                        bins: int = DEFAULT_BINS) -> DataFrame:
    """``by..., feature, psi, rating``; ``reference`` has one row per feature.

    Bins beyond a feature's last edge are empty on both sides and contribute nothing. An empty side is an
    error between two samples; a group without values (or whose feature the reference lacks) has a NULL psi
    and the rating ``no data``.
    """
    expected = reference.select(
        "feature", F.col("n").alias("_m"), *[F.col(c).alias(f"_{c}") for c in _cells(bins)])
    if by:
        joined = current.join(F.broadcast(expected), "feature", "left")
    else:
        joined = expected.join(F.broadcast(current), "feature", "left")
    empty = (F.coalesce(F.col("n"), F.lit(0)) == 0) | (F.coalesce(F.col("_m"), F.lit(0)) == 0)
    total = reduce(lambda a, b: a + b, [
        psi_term(F.col(f"_{c}") / F.col("_m"), F.col(c) / F.col("n")) for c in _cells(bins)])
    without = F.lit(None) if by else F.raise_error(F.concat(F.lit(EMPTY_SIDE + ": "), F.col("feature")))
    psi = F.when(empty, without.cast("double")).otherwise(total)
    rating = F.when(F.col("psi").isNull(), NO_DATA).otherwise(rate_psi(F.col("psi")))
    return joined.select(*by, "feature", psi.alias("psi")).withColumn("rating", rating)


def drift_by(reference: DataFrame, current: DataFrame, features: Sequence[str], by: Sequence[str] = (),
             bins: int = DEFAULT_BINS, *, digits: int | None = None, limit: int = FEW_GROUPS_ROWS) -> DataFrame:
    """PSI of every feature of ``current`` against ``reference``, per group of ``by``.

    The reference is fitted first and kept as local rows, one per feature; the rest is one map-side combined
    pass over the current rows.
    """
    fitted = fit_reference(reference, features, bins, digits=digits, limit=limit)
    expected = expected_counts(reference.sparkSession, fitted, bins)
    return psi_from_histograms(histogram(current, fitted, by, bins), expected, by, bins)


def drift_report(reference: DataFrame, current: DataFrame, features: Sequence[str],
                 bins: int = DEFAULT_BINS, **options) -> DataFrame:
    """Worst feature first; ties by name."""
    return drift_by(reference, current, features, (), bins, **options).orderBy(F.desc("psi"), "feature")


def psi_between(reference: DataFrame, current: DataFrame, column: str, bins: int = DEFAULT_BINS,
                **options) -> DataFrame:
    return drift_by(reference, current, [column], (), bins, **options)


def worst_feature(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("psi"), "feature").limit(1)


def worst_feature_by(report: DataFrame, by: Sequence[str]) -> DataFrame:
    """Highest PSI per group, ties by feature name; a feature without data only if all are."""
    best = F.min_by(F.struct("feature", "psi", "rating"),
                    F.struct(F.col("psi").isNull(), -F.col("psi"), F.col("feature")))
    return report.groupBy(*by).agg(best.alias("_w")).select(*by, "_w.*")
