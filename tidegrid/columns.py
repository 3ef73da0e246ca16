"""Column names, rename maps, feature lists and record schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Header of the raw hourly file and the name used here, in file order.
RAW_HEADER = {
    "Date": "date",
    "Rented Bike Count": "demand",
    "Hour": "hour",
    "Temperature(°C)": "temperature",
    "Humidity(%)": "humidity",
    "Wind speed (m/s)": "wind_speed",
    "Visibility (10m)": "visibility",
    "Dew point temperature(°C)": "dew_point",
    "Solar Radiation (MJ/m2)": "solar",
    "Rainfall(mm)": "rainfall",
    "Snowfall (cm)": "snowfall",
    "Seasons": "season",
    "Holiday": "holiday",
    "Functioning Day": "functioning",
}
HEADER_OF = {ours: theirs for theirs, ours in RAW_HEADER.items()}

TARGET = "target"
RAW_TARGET = "demand"
WEATHER = ["temperature", "humidity", "wind_speed", "visibility", "dew_point", "solar", "rainfall", "snowfall"]
REPLACED = ["date", "hour", "season", "holiday", "functioning"]

CALENDAR = [
    "day_of_week", "month", "day_of_month", "is_weekend", "is_weekday",
    "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
    "is_morning_rush", "is_evening_rush", "is_rush_hour",
    "time_of_day_night", "time_of_day_morning", "time_of_day_afternoon", "time_of_day_evening",
    "is_work_hour",
]
LAGS = [
    "demand_lag_1h", "demand_lag_2h", "demand_lag_3h", "demand_lag_24h", "demand_lag_168h",
    "temp_lag_1h", "humidity_lag_1h", "wind_speed_lag_1h",
]
ROLLING = [
    "demand_rolling_3h_mean", "demand_rolling_6h_mean", "demand_rolling_12h_mean", "demand_rolling_24h_mean",
    "demand_rolling_24h_std", "demand_rolling_24h_min", "demand_rolling_24h_max",
    "temp_rolling_3h_mean", "temp_rolling_3h_std", "temp_rolling_24h_mean",
]
INTERACTIONS = [
    "temp_x_hour", "temp_x_is_rush_hour", "temp_squared", "is_comfortable_weather",
    "has_rain", "has_snow", "has_precipitation", "low_visibility", "bad_weather",
    "wind_chill", "apparent_temp",
]
CHANGES = ["temp_change_1h", "humidity_change_1h", "wind_speed_change_1h"]
ENCODINGS = ["Season_Spring", "Season_Summer", "Season_Winter", "is_holiday", "is_functioning"]
SEASONS = ["Autumn", "Spring", "Summer", "Winter"]
FEATURES = [*WEATHER, *CALENDAR, *LAGS, *ROLLING, *INTERACTIONS, *CHANGES, *ENCODINGS]

# The three named feature sets, in list order.
FEATURE_SET_30 = [
    "demand_lag_1h", "demand_lag_24h", "demand_lag_168h",
    "demand_rolling_3h_mean", "demand_rolling_24h_std", "demand_rolling_24h_max",
    "temperature", "temp_squared", "temp_x_hour",
    "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
    "is_rush_hour", "is_evening_rush", "time_of_day_evening",
    "humidity", "visibility", "solar",
    "is_comfortable_weather", "has_precipitation", "bad_weather",
    "is_weekend", "is_holiday", "is_functioning",
    "Season_Spring", "Season_Summer", "Season_Winter",
]
FEATURE_SET_17 = [
    "temperature", "humidity", "visibility", "solar",
    "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
    "is_rush_hour", "is_weekend", "is_holiday", "is_functioning",
    "Season_Spring", "Season_Summer", "Season_Winter",
]
FEATURE_SET_19 = [*FEATURE_SET_17, "demand_lag_1h", "demand_lag_24h"]
FEATURE_SETS = {30: FEATURE_SET_30, 17: FEATURE_SET_17, 19: FEATURE_SET_19}

# What the tidy table of the tree baseline excludes and treats as categories.
TIDY_EXCLUDED = ["Count", "Date", "Year", "Month", "Day", "DayOfWeek"]
TIDY_CATEGORIES = ["Holiday", "Fday", "WeekStatus", "DayName", "Season"]

_RAW_TYPES = {
    "date": "string", "demand": "bigint", "hour": "int",
    "season": "string", "holiday": "string", "functioning": "string",
}


def raw_type(name: str) -> str:
    """SQL type of a raw column under its own name; measurements are double."""
    return _RAW_TYPES.get(name, "double")


_SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("R2", "RMSE", "MAE")])

LEADERBOARD_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("parameters", T.StringType()),
    T.StructField("train_metrics", _SCORES),
    T.StructField("test_metrics", _SCORES),
])
