"""The feature table from a raw table, whole or for a date range."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.columns import RAW_TARGET, SEASONS, TARGET
from tidegrid.functions.calendar import calendar_features
from tidegrid.functions.encode import binary_encodes, one_hot
from tidegrid.functions.weather import interaction_features
from tidegrid.operators.quality import drop_infinite
from tidegrid.operators.rolling import LONGEST, add_window_features
from tidegrid.operators.selecting import drop_originals
from tidegrid.operators.splitting import split_at_date
from tidegrid.timeline import Timeline


def feature_table(raw: DataFrame, timeline: Timeline, seasons: Sequence[str] = tuple(SEASONS)) -> DataFrame:
    """All features beside the raw columns; one shuffle for every window column.

    ``seasons`` declares the levels, which saves the job that would look them up.
    """
    windowed = add_window_features(raw.withColumn(TARGET, F.col(RAW_TARGET)), timeline)
    return windowed.withColumns(
        calendar_features()
        | interaction_features()
        | one_hot("season", seasons, "Season")
        | binary_encodes()
    )


def model_table(
    raw: DataFrame,
    timeline: Timeline,
    split_date: str,
    seasons: Sequence[str] = tuple(SEASONS),
    keep_originals: bool = False,
) -> DataFrame:
    """Features, then complete rows only, then the split, then originals dropped.

    Windows see the rows of both splits, as they must: a test row may look back
    into the training period, never the other way round.
    """
    complete = drop_infinite(feature_table(raw, timeline, seasons))
    split = split_at_date(complete, "date", split_date)
    return split if keep_originals else drop_originals(split)


def padded_start(start: str, timeline: Timeline, reach: int = LONGEST) -> str:
    """The first time that the rows from ``start`` on look back to."""
    return (datetime.fromisoformat(start) - timedelta(seconds=reach * timeline.step)).isoformat(" ")


def features_for_range(
    raw: DataFrame,
    timeline: Timeline,
    start: str,
    end: str,
    seasons: Sequence[str] = tuple(SEASONS),
    reach: int = LONGEST,
) -> DataFrame:
    """The feature rows of ``[start, end)`` without reading all history.

    A time filter cannot pass below a window, so the input is cut to the range
    plus the longest look-back first, where it can reach the scan. If ``raw`` is
    itself a filled grid, fill it from ``padded_start`` on.
    """
    since = F.lit(start).cast("timestamp_ntz")
    until = F.lit(end).cast("timestamp_ntz")
    padded = F.lit(padded_start(start, timeline, reach)).cast("timestamp_ntz")
    time = F.col(timeline.time)
    return feature_table(raw.where((time >= padded) & (time < until)), timeline, seasons).where(time >= since)
