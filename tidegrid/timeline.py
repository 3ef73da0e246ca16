"""How rows are ordered and how that order is cut into tasks.

A window partitioned by the series alone puts a whole series into one task, so
one hot series would stall the job. Every frame used here has a bounded reach.
The time axis is therefore cut into blocks, each block also receives the rows
just before it (the halo), the window runs per (series, block), and halo rows
are dropped afterwards. The result is the same as without blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_OWN = "_own_block"
_BLOCK = "_block"
_POSITION = "_position"
_FOLLOWS = "_follows"


@dataclass(frozen=True)
class Timeline:
    """Keys, time column and spacing of a set of series.

    ``step`` is the spacing in seconds. Frames count rows. ``complete`` says that
    no series has a gap (``operators.grid.fill_grid``), so that the slot number
    derived from the time is also the row number, and windows raise where a row
    has no time or does not follow the row before it by one step; ``position``
    names a dense row number (``operators.numbering.number_in_series``). With
    neither, rows are numbered where windows need it, those without a time last. ``block`` is the number of rows one window
    task owns; it never changes a result.
    """

    series: tuple[str, ...]
    time: str = "ts"
    step: int = 3600
    block: int = 4096
    position: str | None = None
    complete: bool = False

    def __post_init__(self):
        if isinstance(self.series, str):
            object.__setattr__(self, "series", (self.series,))
        else:
            object.__setattr__(self, "series", tuple(self.series))
        if self.step < 1 or self.block < 1:
            raise ValueError("step and block must be positive")

    def at(self, **changes) -> "Timeline":
        return replace(self, **changes)

    @property
    def keys(self) -> list[str]:
        return [*self.series, self.time]

    def slot(self) -> str:
        """SQL for whole steps since 1970-01-01, free of any time zone; or the position."""
        return f"CAST(`{self.position}` AS BIGINT)" if self.position else slot_of(f"`{self.time}`", self.step)


def slot_of(time: str, step: int) -> str:
    """SQL for the index of the grid cell that ``time`` (date or timestamp_ntz) falls into."""
    days = f"CAST(datediff(CAST({time} AS DATE), DATE'1970-01-01') AS BIGINT)"
    if step % 86400 == 0:
        return days if step == 86400 else f"floor({days} / {step // 86400})"
    clock = f"hour({time}) * 3600 + minute({time}) * 60 + second({time})"
    return f"floor(({days} * 86400 + {clock}) / {step})"


def slot_time(slot: str, step: int) -> str:
    """SQL for the start of a grid cell as timestamp_ntz."""
    seconds = f"({slot} * {step})"
    day = f"CAST(floor({seconds} / 86400) AS INT)"
    rest = f"CAST(pmod({seconds}, 86400L) AS DECIMAL(18,6))"
    return f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval({day}, 0, 0, {rest})"


def over_past(
    df: DataFrame,
    timeline: Timeline,
    reach: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    within: Sequence[str] = (),
) -> DataFrame:
    """Add window columns whose frames look back at most ``reach`` rows.

    ``build`` gets the window (partition and order set, no frame) and returns the
    new columns. All of them share one exchange, one sort and one window node.
    ``within`` lists further partition columns, for example the split. A split
    may take any rows, so they are numbered then even on a complete grid.
    """
    if reach < 0:
        raise ValueError("reach must not be negative")
    if timeline.position is None and (within or not timeline.complete):
        from tidegrid.operators.numbering import number_in_series

        numbered = number_in_series(df, timeline, within, _POSITION)
        return over_past(numbered, timeline.at(position=_POSITION), reach, build, within).drop(_POSITION)
    slot = timeline.slot()
    declared = timeline.position is None
    if declared:
        reach = max(reach, 1)  # the row before is needed to see that it is there
        slot = f"coalesce({slot}, CAST(raise_error('a complete series has a row without a time') AS BIGINT))"
    own = f"floor({slot} / {timeline.block})"
    last = f"floor(({slot} + {reach}) / {timeline.block})"
    order = timeline.position or timeline.time
    spread = df.selectExpr("*", f"{own} AS {_OWN}", f"explode(sequence({own}, {last})) AS {_BLOCK}")
    # as many tasks as there are shuffle partitions: rows of a grid compress to a few bytes, so that partitions
    # which are put together by their compressed size would be sorted by the million
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = spread.repartition(tasks, *timeline.series, *within, _BLOCK)
    window = Window.partitionBy(*timeline.series, *within, _BLOCK).orderBy(order)
    built = build(window)
    if declared:
        step = F.expr(timeline.slot()) - F.lag(F.expr(timeline.slot()), 1).over(window)
        gap = F.raise_error(F.lit("a series that is declared complete has a gap or a time twice")).cast("boolean")
        built = {**built, _FOLLOWS: F.when(F.coalesce(step, F.lit(1)) == 1, True).otherwise(gap)}
    kept = [f"`{c}`" for c in df.columns if c not in built]
    wide = spread.select(*kept, _OWN, _BLOCK, *[column.alias(name) for name, column in built.items()])
    own_rows = f"{_OWN} = {_BLOCK}" + (f" AND {_FOLLOWS}" if declared else "")
    return wide.where(own_rows).drop(_OWN, _BLOCK, _FOLLOWS)
