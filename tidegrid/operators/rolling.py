"""Lag, rolling and change features. No frame reaches the current row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidegrid.timeline import Timeline, over_past

DEMAND_LAGS = (1, 2, 3, 24, 168)
DEMAND_MEANS = (3, 6, 12, 24)
LONGEST = max(DEMAND_LAGS)


def past(window: WindowSpec, rows: int) -> WindowSpec:
    """The ``rows`` rows before the current one; shorter at the start of a series."""
    return window.rowsBetween(-rows, -1)


def demand_lags(window: WindowSpec, demand: str = "demand") -> dict[str, Column]:
    return {f"demand_lag_{k}h": F.lag(demand, k).over(window) for k in DEMAND_LAGS}


def weather_lags(window: WindowSpec) -> dict[str, Column]:
    return {
        "temp_lag_1h": F.lag("temperature", 1).over(window),
        "humidity_lag_1h": F.lag("humidity", 1).over(window),
        "wind_speed_lag_1h": F.lag("wind_speed", 1).over(window),
    }


def demand_means(window: WindowSpec, demand: str = "demand") -> dict[str, Column]:
    return {f"demand_rolling_{n}h_mean": F.avg(demand).over(past(window, n)) for n in DEMAND_MEANS}


def demand_spread(window: WindowSpec, demand: str = "demand") -> dict[str, Column]:
    """Sample deviation; NULL below two values."""
    return {"demand_rolling_24h_std": F.stddev_samp(demand).over(past(window, 24))}


def demand_extremes(window: WindowSpec, demand: str = "demand") -> dict[str, Column]:
    day = past(window, 24)
    return {
        "demand_rolling_24h_min": F.min(demand).over(day),
        "demand_rolling_24h_max": F.max(demand).over(day),
    }


def temperature_rolling(window: WindowSpec) -> dict[str, Column]:
    return {
        "temp_rolling_3h_mean": F.avg("temperature").over(past(window, 3)),
        "temp_rolling_3h_std": F.stddev_samp("temperature").over(past(window, 3)),
        "temp_rolling_24h_mean": F.avg("temperature").over(past(window, 24)),
    }


def changes(window: WindowSpec) -> dict[str, Column]:
    before = weather_lags(window)
    return {
        "temp_change_1h": F.col("temperature") - before["temp_lag_1h"],
        "humidity_change_1h": F.col("humidity") - before["humidity_lag_1h"],
        "wind_speed_change_1h": F.col("wind_speed") - before["wind_speed_lag_1h"],
    }


def window_features(window: WindowSpec) -> dict[str, Column]:
    """Every window column of the feature table."""
    return (
        demand_lags(window) | weather_lags(window)
        | demand_means(window) | demand_spread(window) | demand_extremes(window) | temperature_rolling(window)
        | changes(window)
    )


def add_window_features(df: DataFrame, timeline: Timeline) -> DataFrame:
    return over_past(df, timeline, LONGEST, window_features)
