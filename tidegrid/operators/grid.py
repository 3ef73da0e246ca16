"""Events to a complete, equally spaced grid per series."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.timeline import Timeline, slot_of, slot_time

_SLOT, _CHUNK, _MARKER, _BEFORE, _CELL = "_slot", "_chunk", "_marker", "_before", "_cell"


def fill_grid(
    events: DataFrame,
    timeline: Timeline,
    measures: dict[str, Column | str],
    bounds: str = "all",
    since: str | None = None,
    until: str | None = None,
) -> DataFrame:
    """One row per series and step, with gaps filled.

    ``measures`` are aggregates over one cell, as columns or SQL text. They must skip NULL inputs, since
    an empty cell is fed to them as a row of NULLs: count a never-null column,
    not ``*``, and wrap a result in ``coalesce`` for its default.
    ``bounds`` is ``"all"`` (every series spans the whole data) or ``"series"``.

    ``since`` and ``until`` give the part ``[since, until)`` of that grid. Events
    outside it are then filtered at the scan; only the keys and times that set the
    bounds are still read.

    Only cells with events are aggregated and shuffled. Each piece of ``block`` steps
    gets two markers, around its first and last cell, and a cell or marker then
    makes the empty cells between it and the one before. So empty cells need
    neither memory nor a shuffle, however many there are to an event. A cell holding
    a large share of all events is reduced by the map-side partial aggregate first.
    """
    if bounds not in ("all", "series"):
        raise ValueError("bounds must be 'all' or 'series'")
    for limit in (since, until):
        if limit and (datetime.fromisoformat(limit) - datetime(1970, 1, 1)).total_seconds() % timeline.step:
            raise ValueError(f"{limit} is not on the grid")
    keys = list(timeline.series)
    time = f"`{timeline.time}`"
    wanted = events
    if since:
        wanted = wanted.where(f"{time} >= TIMESTAMP_NTZ'{since}'")
    if until:
        wanted = wanted.where(f"{time} < TIMESTAMP_NTZ'{until}'")
    slot = slot_of(time, timeline.step)
    cells = wanted.selectExpr("*", f"{slot} AS {_SLOT}").drop(timeline.time)
    spans = events.selectExpr(*keys, f"{slot} AS {_SLOT}").groupBy(*keys).agg(
        F.min(_SLOT).alias("_lo"), F.max(_SLOT).alias("_hi"))
    if bounds == "all":
        span = spans.agg(F.struct(F.min("_lo").alias("lo"), F.max("_hi").alias("hi")).alias("span")).scalar()
        spans = spans.select(*keys, span.getField("lo").alias("_lo"), span.getField("hi").alias("_hi"))
    lo, hi = "_lo", "_hi"
    if since:
        lo = f"greatest(_lo, {slot_of(f"TIMESTAMP_NTZ'{since}'", timeline.step)})"
    if until:
        hi = f"least(_hi, {slot_of(f"TIMESTAMP_NTZ'{until}'", timeline.step)} - 1)"
    spans = spans.selectExpr(*keys, f"{lo} AS _lo", f"{hi} AS _hi").where("_lo <= _hi")
    size = timeline.block
    # two levels, so that no single array grows with the length of the span
    chunks = spans.selectExpr("*", f"explode(sequence(floor(_lo / {size}), floor(_hi / {size}))) AS {_CHUNK}")
    first, last = f"greatest(_lo, {_CHUNK} * {size})", f"least(_hi, {_CHUNK} * {size} + {size - 1})"
    markers = chunks.selectExpr(*keys, _CHUNK, f"explode(array({first} - 1, {last} + 1)) AS {_SLOT}", f"true AS {_MARKER}")
    built = [(F.expr(m) if isinstance(m, str) else m).alias(n) for n, m in measures.items()]
    held = cells.groupBy(*keys, _SLOT).agg(*built).selectExpr("*", f"floor({_SLOT} / {size}) AS {_CHUNK}", f"false AS {_MARKER}")
    along = Window.partitionBy(*keys, _CHUNK).orderBy(_SLOT)
    # the cells after the one before, up to its own; a marker is no cell, and a cell without a time is alone
    before = F.lag(_SLOT, 1).over(along).alias(_BEFORE)
    after = f"coalesce({_BEFORE} + 1, {_SLOT})"
    until_own = f"IF({_MARKER}, {_SLOT} - 1, {_SLOT})"
    made = f"CASE WHEN {_SLOT} IS NULL THEN array({_SLOT}) WHEN {after} <= {until_own} THEN sequence({after}, {until_own}) END"
    merged = held.unionByName(markers, allowMissingColumns=True)
    wide = merged.select("*", before).selectExpr("*", f"explode({made}) AS {_CELL}")
    nothing = _of_nothing(cells, built)
    own = F.col(_CELL).eqNullSafe(F.col(_SLOT))
    values = [F.when(own, F.col(n)).otherwise(nothing.getField(n)).alias(n) for n in measures]
    return wide.select(*keys, F.expr(slot_time(_CELL, timeline.step)).alias(timeline.time), *values)


def _of_nothing(cells: DataFrame, built: Sequence[Column]) -> Column:
    """What the measures give for an empty cell: one row of NULLs."""
    row = [F.lit(None).cast(f.dataType).alias(f.name) for f in cells.schema.fields]
    return cells.sparkSession.range(1).select(*row).agg(*built).select(F.struct("*")).scalar()
