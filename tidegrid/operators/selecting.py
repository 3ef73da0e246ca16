"""Sort, projection, row filter and limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.columns import FEATURE_SETS, RAW_TARGET, REPLACED, TARGET
from tidegrid.operators.quality import drop_incomplete
from tidegrid.timeline import Timeline


def chronological(df: DataFrame, timeline: Timeline) -> DataFrame:
    """Rows of each partition in time order; for sinks. Windows sort by themselves.

    Series and day decide the partition, so a long series is still many tasks.
    """
    day = F.col(timeline.time).cast("date")
    return df.repartition(*timeline.series, day).sortWithinPartitions(*timeline.keys)


def copy_target(df: DataFrame, source: str = RAW_TARGET, name: str = TARGET) -> DataFrame:
    return df.withColumn(name, F.col(source))


def drop_originals(df: DataFrame, columns: Sequence[str] = tuple(REPLACED)) -> DataFrame:
    """Drop the columns that features have replaced; absent ones do not matter."""
    return df.drop(*columns)


def feature_set(df: DataFrame, names: int | Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """A named feature set in list order, without the names the table lacks."""
    wanted = FEATURE_SETS[names] if isinstance(names, int) else names
    return df.select(*keep, *[c for c in wanted if c in df.columns])


def target_of(df: DataFrame) -> str:
    return TARGET if TARGET in df.columns else RAW_TARGET


def features_of(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """All columns but the two targets and ``exclude``, in frame order."""
    left_out = {TARGET, RAW_TARGET, *exclude}
    return [c for c in df.columns if c not in left_out]


def complement(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    return df.select(*features_of(df, exclude), target_of(df))


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with no NULL or NaN in ``columns`` (all by default)."""
    return drop_incomplete(df, columns)


def head(df: DataFrame, timeline: Timeline, n: int) -> DataFrame:
    """The first ``n`` rows by time, then series."""
    return df.orderBy(timeline.time, *timeline.series).limit(n)


def top(df: DataFrame, by: str, n: int = 15, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(n)
