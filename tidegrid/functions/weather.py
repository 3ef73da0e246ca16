"""Row-local features of the measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.functions.calendar import EVENING_RUSH, MORNING_RUSH, flag, one_of

# Thresholds and coefficients of the derived measurements.
COMFORT_TEMPERATURE = (10, 25)
COMFORT_HUMIDITY = 70
LOW_VISIBILITY = 1000
WIND_FACTOR = 0.7
HUMIDITY_FACTOR = 0.4


def temperature_interactions(temperature: str = "temperature", hour: str = "hour") -> dict[str, Column]:
    rush = one_of(hour, MORNING_RUSH + EVENING_RUSH)
    return {
        "temp_x_hour": F.expr(f"{temperature} * {hour}"),
        "temp_x_is_rush_hour": F.expr(f"{temperature} * CAST(coalesce({rush}, false) AS INT)"),
        "temp_squared": F.expr(f"{temperature} * {temperature}"),
    }


def comfort_flag(temperature: str = "temperature", humidity: str = "humidity") -> dict[str, Column]:
    low, high = COMFORT_TEMPERATURE
    mild = f"{temperature} > {low} AND {temperature} < {high}"
    return {"is_comfortable_weather": flag(f"{mild} AND {humidity} < {COMFORT_HUMIDITY}")}


def precipitation_flags(rainfall: str = "rainfall", snowfall: str = "snowfall") -> dict[str, Column]:
    return {
        "has_rain": flag(f"{rainfall} > 0"),
        "has_snow": flag(f"{snowfall} > 0"),
        "has_precipitation": flag(f"{rainfall} > 0 OR {snowfall} > 0"),
    }


def bad_weather_flags(
    rainfall: str = "rainfall", snowfall: str = "snowfall", visibility: str = "visibility"
) -> dict[str, Column]:
    poor = f"{visibility} < {LOW_VISIBILITY}"
    return {"low_visibility": flag(poor), "bad_weather": flag(f"{rainfall} > 0 OR {snowfall} > 0 OR {poor}")}


def wind_chill(temperature: str = "temperature", wind_speed: str = "wind_speed") -> dict[str, Column]:
    return {"wind_chill": F.expr(f"{temperature} - {wind_speed} * {WIND_FACTOR}D")}


def apparent_temperature(temperature: str = "temperature", humidity: str = "humidity") -> dict[str, Column]:
    felt = f"{temperature} - {HUMIDITY_FACTOR}D * ({temperature} - 10) * (1 - {humidity} / 100)"
    return {"apparent_temp": F.expr(felt)}


def interaction_features() -> dict[str, Column]:
    """All eleven over the standard column names, in the order of the feature table."""
    return (
        temperature_interactions() | comfort_flag() | precipitation_flags() | bad_weather_flags()
        | wind_chill() | apparent_temperature()
    )
