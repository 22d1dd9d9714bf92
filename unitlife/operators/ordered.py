"""Per-unit ordered computation that does not put a whole unit into one task.

A plain ``Window.partitionBy(unit)`` sends every row of a unit to one task, which fails once a
single unit holds a large share of the table. Here a unit's history is cut into chunks by an
integer order column that is unique inside the unit, at ranks and not at values, so a chunk never holds more than
``chunk_rows`` rows however the order is spread, and windows run per ``(unit, chunk)``:

* ``neighbours`` serves bounded frames (lags, leads, rolling windows). Rows near a chunk border
  are copied into the adjacent chunk before one shuffle, and the copies are dropped afterwards.
* ``running`` serves unbounded-preceding frames (counts, sums, carry-forward). If some unit is
  longer than a chunk, each chunk is pre-aggregated to one row, the chunk rows are scanned per
  unit, and the result is handed back; otherwise a plain window does.
* ``unit_values`` attaches a whole-unit aggregate to every chunk of the unit.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from unitlife.session import use_checkpoints

CHUNK_ROWS = 1 << 20
MIN_CELLS = 1 << 12
CHUNK = "_chunk"


def chunk_of(order: Column, chunk_rows: int = CHUNK_ROWS) -> Column:
    return F.floor(order / F.lit(chunk_rows))


def fits_one_task(df: DataFrame, unit: Sequence[str], limit: int = CHUNK_ROWS) -> bool:
    """Whether no unit has more than ``limit`` rows; one narrow, map-side combined count."""
    return df.groupBy(*unit).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).isEmpty()


def place(df: DataFrame, unit: Sequence[str], order: str, *, dense: bool,
          chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the chunk column.

    ``dense``: ``order`` counts the unit's own rows, so ordinary units fall into one chunk by
    themselves. Otherwise (an event number shared by all units, a time, any number with gaps) units with more
    than ``chunk_rows`` rows are cut by rank. Their range is divided into equal cells, whose rows are counted; a cell of more than half a
    chunk (a burst, or all but an outlier) is divided again, between its own least and greatest row, until none is. The
    cells' counts, summed in order, give every cell its rank, and a chunk takes the cells that start in its half chunk
    of ranks: two halves at most. Each round is one map-side combined count over large units; evenly spread orders need one.
    """
    if dense:
        return df.withColumn(CHUNK, chunk_of(F.col(order), chunk_rows))
    unit, half, at = list(unit), max(chunk_rows // 2, 1), F.col(order).cast("bigint")
    bounds = [F.count("*").alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi")]

    def wanted(cells: DataFrame, most: int) -> DataFrame:
        pieces = F.greatest(F.lit(MIN_CELLS).cast("bigint"), F.expr(f"4 * _n div {chunk_rows}")).alias("_pieces")
        crowded = cells.filter((F.col("_n") > most) & (F.col("_hi") > F.col("_lo"))).select("*", pieces)
        return crowded.select(*keys, "_lo", F.expr("(_hi - _lo) div _pieces + 1").alias("_width"))

    use_checkpoints(df.sparkSession)
    keys, rows = list(unit), df
    divided = wanted(df.groupBy(*unit).agg(*bounds), chunk_rows).checkpoint()  # small, and read by every later round
    while True:
        cell = f"_cell{len(keys) - len(unit)}"
        rows = rows.join(divided, keys, "left").withColumn(
            cell, F.coalesce(F.expr(f"(CAST(`{order}` AS BIGINT) - _lo) div _width"), F.lit(-1))).drop("_lo", "_width")
        keys.append(cell)
        counts = rows.filter(F.col("_cell0") >= 0).groupBy(*keys).agg(*bounds)
        divided = wanted(counts.filter(F.col(cell) >= 0), half).checkpoint()
        if divided.isEmpty():
            break
    before = Window.partitionBy(*unit).orderBy(*keys[len(unit):]).rowsBetween(Window.unboundedPreceding, -1)
    chunks = counts.select(*keys, F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / half).cast("bigint").alias(CHUNK)).checkpoint()
    return (
        rows.join(chunks, keys, "left").withColumn(CHUNK, F.coalesce(F.col(CHUNK), F.lit(0)).cast("bigint"))
        .select(*df.columns, CHUNK)
    )


def running(df: DataFrame, unit: Sequence[str], order: str, *, dense: bool,
            sums: Mapping[str, Column] | None = None,
            last_of: tuple[Column, Mapping[str, Column]] | None = None,
            chunk_rows: int = CHUNK_ROWS, small: bool | None = None) -> DataFrame:
    """Add values accumulated over the unit's *preceding* rows (the current row is excluded).

    ``sums`` maps a name to the summed expression. ``last_of`` is ``(event, payload)``: the
    payload of the most recent preceding row where ``event`` holds, NULL if there is none.
    ``order`` is a unique integer inside a unit; ``dense`` as in ``place``. ``small`` says that
    every unit fits one task; by default that is checked with one narrow job, which for a dense
    order is a filter that file statistics can answer.
    """
    sums = dict(sums or {})
    event, payload = last_of or (F.lit(False), {})
    originals = df.columns
    parts = {f"_s_{n}": e for n, e in sums.items()}
    if payload:
        parts["_at"] = F.when(event, F.col(order))
        parts.update({f"_p_{n}": e for n, e in payload.items()})
        held = F.when(F.col("_at").isNotNull(), F.struct(*[F.col(f"_p_{n}").alias(n) for n in payload]))
    if small is None:
        beyond = (F.col(order) >= chunk_rows) | (F.col(order) <= -chunk_rows)
        small = df.filter(beyond).isEmpty() if dense else fits_one_task(df, unit, chunk_rows)

    def accumulated(rows: DataFrame, within: Sequence[str], carried: bool) -> DataFrame:
        inside = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        columns = []
        for n in sums:
            total = F.coalesce(F.sum(f"_s_{n}").over(inside), F.lit(0))
            columns.append((total + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) if carried else total).alias(n))
        if payload:
            last = F.last(held, ignorenulls=True).over(inside)
            columns.append((F.coalesce(last, F.col("_c_held")) if carried else last).alias("_held"))
        result = rows.select(*originals, *columns)
        if payload:
            result = result.select("*", *[F.col(f"_held.{n}").alias(n) for n in payload]).drop("_held")
        return result

    if small:
        return accumulated(df.withColumns(parts), unit, carried=False)

    rows = place(df, unit, order, dense=dense, chunk_rows=chunk_rows).withColumns(parts)
    totals = rows.groupBy(*unit, CHUNK).agg(
        *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums],
        *([F.max("_at").alias("_at")] if payload else []),
        *[F.max_by(f"_p_{n}", "_at").alias(f"_p_{n}") for n in payload],
    )
    across = Window.partitionBy(*unit).orderBy(CHUNK)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *unit, CHUNK,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *([F.last(held, ignorenulls=True).over(before).alias("_c_held")] if payload else []),
        F.lag(CHUNK).over(across).alias("_has_previous"),
    ).filter(F.col("_has_previous").isNotNull()).drop("_has_previous")
    return accumulated(rows.join(carried, [*unit, CHUNK], "left"), [*unit, CHUNK], carried=True)


def with_ordinal(df: DataFrame, unit: Sequence[str], order: str, name: str, *,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Dense 1-based position of each row inside its unit; ``order`` is a unique integer."""
    counted = running(df, unit, order, dense=False, sums={"_before": F.lit(1)}, chunk_rows=chunk_rows)
    return counted.withColumn(name, F.col("_before") + 1).drop("_before")


def neighbours(df: DataFrame, unit: Sequence[str], position: str, *, before: int = 0,
               after: int = 0, columns: Mapping[str, Callable[[WindowSpec], Column]],
               chunk_rows: int = CHUNK_ROWS, keep_chunk: bool = False) -> DataFrame:
    """Evaluate window expressions that look at most ``before`` rows back and ``after`` ahead.

    ``position`` must be dense and 1-based inside the unit. Each expression gets the window
    ordered by ``position``. One shuffle on (unit, chunk); a chunk holds at most
    ``chunk_rows + before + after`` rows.
    """
    index = F.col(position) - 1
    home = chunk_of(index, chunk_rows)
    first = F.greatest(chunk_of(index - after, chunk_rows), F.lit(0).cast("bigint"))
    last = chunk_of(index + before, chunk_rows)
    spread = df.withColumn(CHUNK, F.explode(F.sequence(first, last)))
    window = Window.partitionBy(*unit, CHUNK).orderBy(position)
    result = spread.select(
        *spread.columns, *[build(window).alias(name) for name, build in columns.items()]
    ).filter(F.col(CHUNK) == home)
    return result if keep_chunk else result.drop(CHUNK)


def ensure_chunk(df: DataFrame, position: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    if CHUNK in df.columns:
        return df
    return df.withColumn(CHUNK, chunk_of(F.col(position) - 1, chunk_rows))


def unit_values(chunked: DataFrame, unit: Sequence[str],
                values: Mapping[str, tuple[Column, Callable]]) -> DataFrame:
    """Whole-unit aggregates, one row per (unit, chunk), for a join that has no hot key.

    ``values`` maps a name to ``(partial, merge)``: ``partial`` aggregates a chunk, ``merge``
    (``F.min``, ``F.max`` or ``F.sum``) combines the partials. A unit has at most
    rows / chunk_rows partials, so the second step stays small however large the unit is.
    """
    partials = chunked.groupBy(*unit, CHUNK).agg(
        *[partial.alias(name) for name, (partial, _) in values.items()])
    whole = Window.partitionBy(*unit)
    return partials.select(
        *unit, CHUNK, *[merge(name).over(whole).alias(name) for name, (_, merge) in values.items()])


def join_on_units(chunked: DataFrame, dimension: DataFrame, unit: Sequence[str],
                  how: str = "inner") -> DataFrame:
    """Join a per-unit table to rows at (unit, chunk) grain, so that no join key is hot."""
    grains = chunked.select(*unit, CHUNK).distinct()
    return chunked.join(grains.join(dimension, list(unit), how), [*unit, CHUNK], how)
