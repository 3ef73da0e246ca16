"""Dense row numbers without one task per group.

Rows are cut into buckets whose order agrees with the wanted order; each bucket
is counted, the counts are summed up over the (few) buckets, and rows are
numbered inside their bucket only, after a row that brings the sum so far.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.hashing import hash_bucket
from tidegrid.timeline import Timeline, slot_of

_BUCKET, _BEFORE, _WHOLE = "_bucket", "_rows_before", "_rows_in_all"
_NUMBER, _TOTAL = "_row_number", "_row_total"
#: Buckets of rows without a time: beyond all blocks of the time axis.
_UNTIMED = 1 << 61


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column | str],
    name: str = "position",
    total: str | None = None,
) -> DataFrame:
    """1-based number per ``keys`` in the order of (bucket, order); NULL keys are a group of their own,
    rows without a bucket count but are dropped.

    ``bucket`` must not decrease along the wanted order, and ``order`` must be
    unique inside a bucket. ``total`` adds the row count of the group.
    """
    keys = list(keys)
    rows = df.withColumn(_BUCKET, bucket)
    counts = rows.groupBy(*keys, _BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*keys).orderBy(_BUCKET)
    before = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = counts.select(*keys, _BUCKET, before.alias(_BEFORE), whole.alias(_WHOLE))
    # a bucket's head comes first in it: no join, whose small side could be planned as a broadcast
    bucket_rows = Window.partitionBy(*keys, _BUCKET).orderBy(F.col(_BEFORE).isNull(), *order)
    seen = bucket_rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.first(_BEFORE).over(seen) + F.row_number().over(bucket_rows) - 1
    numbers = [number.alias(_NUMBER), *([F.first(_WHOLE).over(seen).alias(_TOTAL)] if total else [])]
    wide = rows.unionByName(heads, allowMissingColumns=True).select("*", *numbers).where(F.col(_BEFORE).isNull() & F.col(_BUCKET).isNotNull())
    kept = [c for c in df.columns if c not in (name, total)]
    return wide.select(*kept, F.col(_NUMBER).alias(name), *([F.col(_TOTAL).alias(total)] if total else []))


def number_in_series(
    df: DataFrame,
    timeline: Timeline,
    within: Sequence[str] = (),
    name: str = "position",
    total: str | None = None,
) -> DataFrame:
    """Number the rows of each series by time; gaps do not count.

    Times must be unique within a series (and ``within``), at ``step`` or coarser. Rows
    without a time come last, in the order of a hash of their columns, which also deals
    them out over buckets.
    """
    block = F.expr(f"floor({slot_of(f'`{timeline.time}`', timeline.step)} / {timeline.block})")
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    untimed = F.when(F.col(timeline.time).isNull(), F.xxhash64(*plain))
    last = F.lit(_UNTIMED) + F.shiftright(untimed, 48)
    return number_rows(df, [*timeline.series, *within], F.coalesce(block, last), [timeline.time, untimed], name, total)


def number_by_hash(
    df: DataFrame,
    keys: Sequence[str],
    hashed: Column,
    bits: int,
    ties: Sequence[str],
    name: str = "position",
    total: str | None = None,
) -> DataFrame:
    """A shuffled but repeatable numbering: by hash value, then ``ties``."""
    return number_rows(df, keys, hash_bucket(hashed, bits), [hashed, *[F.col(t) for t in ties]], name, total)
