"""Calendar, measurement and encoding features; the whole feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.columns import FEATURES, SEASONS
from tidegrid.functions import calendar, encode, weather
from tidegrid.operators.rolling import changes
from tidegrid.plans.features import feature_table, features_for_range, model_table, padded_start
from tidegrid.queries.base import (
    CALENDAR_SQL, DAILY, DAILY_SQL, HOURLY, INTERACTION_SQL, SPLIT_DATE, SPLIT_SQL, WINDOW_SQL, daily_orders,
    features_sql, hourly_events, hourly_sql, query, s6, shown, shown_sql,
)
from tidegrid.operators.splitting import split_at_date
from tidegrid.timeline import over_past

KEYS = ["series", "ts"]


def _row_local(spark, folder, features, names=None):
    raw = hourly_events(spark, folder).withColumns(features)
    return raw.select(*KEYS, *shown(names or features))


def _row_local_sql(expressions: dict[str, str]) -> str:
    return hourly_sql() + ",\nf AS (SELECT series, ts, " + ", ".join(
        f"{e} AS {n}" for n, e in expressions.items()
    ) + f" FROM hourly)\nSELECT series, ts, {shown_sql(expressions)} FROM f"


def _part(source: dict[str, str], *names: str) -> dict[str, str]:
    return {n: source[n] for n in names}


@query("d01_date_parse", DAILY_SQL + """
SELECT series, ts, strftime(date, '%d/%m/%Y') AS date_text, date AS parsed FROM daily""")
def d01(spark, folder):
    daily = daily_orders(spark, folder).withColumn("date_text", F.date_format("date", "dd/MM/yyyy"))
    return daily.select(*KEYS, "date_text", calendar.parse_date("date_text").alias("parsed"))


@query("d02_calendar_parts", DAILY_SQL + f"""
SELECT series, ts, {', '.join(f'{CALENDAR_SQL[n]} AS {n}' for n in ('day_of_week', 'month', 'day_of_month'))} FROM daily""")
def d02(spark, folder):
    return daily_orders(spark, folder).withColumns(calendar.date_parts()).select(
        *KEYS, "day_of_week", "month", "day_of_month")


@query("d03_weekend_flags", DAILY_SQL + f"""
SELECT series, ts, {', '.join(f'{CALENDAR_SQL[n]} AS {n}' for n in ('is_weekend', 'is_weekday'))} FROM daily""")
def d03(spark, folder):
    return daily_orders(spark, folder).withColumns(calendar.weekend_flags()).select(
        *KEYS, "is_weekend", "is_weekday")


_CYCLES = ("hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos")


@query("d04_cyclical", _row_local_sql(_part(CALENDAR_SQL, *_CYCLES)))
def d04(spark, folder):
    return _row_local(spark, folder, calendar.cycles(), _CYCLES)


@query("d04_cyclical_month", DAILY_SQL + f"""
SELECT series, ts, {', '.join(s6(CALENDAR_SQL[n], n) for n in _CYCLES[2:])} FROM daily""")
def d04_month(spark, folder):
    cycles = calendar.cycles(hour=None)
    return daily_orders(spark, folder).withColumns(cycles).select(*KEYS, *shown(cycles))


@query("d05_rush_hours", _row_local_sql(_part(CALENDAR_SQL, "is_morning_rush", "is_evening_rush", "is_rush_hour")))
def d05(spark, folder):
    return _row_local(spark, folder, calendar.rush_hour_flags())


@query("d06_part_of_day", _row_local_sql(_part(
    CALENDAR_SQL, *[f"time_of_day_{p}" for p in ("night", "morning", "afternoon", "evening")])))
def d06(spark, folder):
    return _row_local(spark, folder, calendar.part_of_day_flags())


@query("d07_work_hour", _row_local_sql(_part(CALENDAR_SQL, "is_work_hour")))
def d07(spark, folder):
    return _row_local(spark, folder, calendar.work_hour_flag())


@query("d08_date_range", hourly_sql() + f"""
SELECT split, min(date) AS first_date, max(date) AS last_date
FROM (SELECT date, {SPLIT_SQL} AS split FROM hourly) GROUP BY split""")
def d08(spark, folder):
    return calendar.date_range(split_at_date(hourly_events(spark, folder), "date", SPLIT_DATE), "date", ["split"])


@query("e01_temperature_interactions", _row_local_sql(_part(
    INTERACTION_SQL, "temp_x_hour", "temp_x_is_rush_hour", "temp_squared")))
def e01(spark, folder):
    return _row_local(spark, folder, weather.temperature_interactions())


@query("e02_comfort", _row_local_sql(_part(INTERACTION_SQL, "is_comfortable_weather")))
def e02(spark, folder):
    return _row_local(spark, folder, weather.comfort_flag())


@query("e03_precipitation", _row_local_sql(_part(INTERACTION_SQL, "has_rain", "has_snow", "has_precipitation")))
def e03(spark, folder):
    return _row_local(spark, folder, weather.precipitation_flags())


@query("e04_bad_weather", _row_local_sql(_part(INTERACTION_SQL, "low_visibility", "bad_weather")))
def e04(spark, folder):
    return _row_local(spark, folder, weather.bad_weather_flags())


@query("e05_wind_chill", _row_local_sql(_part(INTERACTION_SQL, "wind_chill")))
def e05(spark, folder):
    return _row_local(spark, folder, weather.wind_chill())


@query("e06_apparent_temperature", _row_local_sql(_part(INTERACTION_SQL, "apparent_temp")))
def e06(spark, folder):
    return _row_local(spark, folder, weather.apparent_temperature())


_CHANGES = ("temp_change_1h", "humidity_change_1h", "wind_speed_change_1h")


@query("e07_changes", _row_local_sql(_part(WINDOW_SQL, *_CHANGES)))
def e07(spark, folder):
    return over_past(hourly_events(spark, folder), HOURLY, 1, changes).select(*KEYS, *shown(_CHANGES))


@query("e08_binary_encodes", hourly_sql() + """
SELECT series, ts, CAST(holiday = 'Holiday' AS INTEGER) AS is_holiday,
       CAST(functioning = 'Yes' AS INTEGER) AS is_functioning FROM hourly""")
def e08(spark, folder):
    return _row_local(spark, folder, encode.binary_encodes())


@query("e09_one_hot", hourly_sql() + """
SELECT series, ts, CAST(season = 'Spring' AS INTEGER) AS Season_Spring,
       CAST(season = 'Summer' AS INTEGER) AS Season_Summer, CAST(season = 'Winter' AS INTEGER) AS Season_Winter
FROM hourly""")
def e09(spark, folder):
    raw = hourly_events(spark, folder)
    return _row_local(spark, folder, encode.one_hot("season", encode.levels_of(raw, "season"), "Season"))


@query("e10_factor_codes", hourly_sql() + """
SELECT series, ts,
       CASE season WHEN 'Autumn' THEN 0 WHEN 'Spring' THEN 1 WHEN 'Summer' THEN 2 ELSE 3 END AS season,
       CASE holiday WHEN 'Holiday' THEN 0 ELSE 1 END AS holiday,
       functioning, CAST(functioning = 'Yes' AS INTEGER) AS functioning_Yes
FROM hourly""")
def e10(spark, folder):
    raw = hourly_events(spark, folder).withColumn("functioning_Yes", calendar.flag("functioning = 'Yes'"))
    coded = encode.factor_codes(raw, ["season", "holiday", "functioning"])
    return coded.select(*KEYS, "season", "holiday", "functioning", "functioning_Yes")


@query("feature_table", hourly_sql() + features_sql() + f"""
SELECT series, ts, target, {shown_sql(FEATURES)} FROM feat""")
def whole(spark, folder):
    return feature_table(hourly_events(spark, folder), HOURLY, SEASONS).select(*KEYS, "target", *shown(FEATURES))


@query("feature_table_by_type", hourly_sql("event_type") + features_sql() + f"""
SELECT series, ts, target, {shown_sql(FEATURES, 9)} FROM feat""")
def whole_by_type(spark, folder):
    # busy cells have means that end in a 5 at the seventh digit, hence nine digits;
    # few long series: small blocks, so that each series is many window tasks
    timeline = HOURLY.at(block=240)
    raw = hourly_events(spark, folder, "event_type")
    return feature_table(raw, timeline, SEASONS).select(*KEYS, "target", *shown(FEATURES, 9))


@query("model_table", hourly_sql() + features_sql() + f"""
SELECT split, target, {shown_sql(['demand', *FEATURES])} FROM feat
WHERE demand_lag_168h IS NOT NULL""")
def complete(spark, folder):
    return model_table(hourly_events(spark, folder), HOURLY, SPLIT_DATE).select(
        "split", "target", *shown(["demand", *FEATURES]))


@query("features_for_range", hourly_sql() + features_sql() + f"""
SELECT series, ts, target, {shown_sql(FEATURES)} FROM feat
WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND ts < TIMESTAMP '2024-01-22 00:00:00'""")
def ranged(spark, folder):
    start, end = "2024-01-20 00:00:00", "2024-01-22 00:00:00"
    raw = hourly_events(spark, folder, since=padded_start(start, HOURLY), until=end)
    return features_for_range(raw, HOURLY, start, end).select(*KEYS, "target", *shown(FEATURES))


@query("daily_lags", DAILY_SQL + """
SELECT series, ts, demand, lag(demand, 7) OVER (PARTITION BY series ORDER BY ts) AS demand_lag_7d,
       round(avg(temperature) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4)
         + 0.0 AS temp_rolling_7d_mean
FROM daily""")
def daily_lags(spark, folder):
    built = over_past(daily_orders(spark, folder), DAILY.at(block=365), 7, lambda w: {
        "demand_lag_7d": F.lag("demand", 7).over(w),
        "temp_rolling_7d_mean": F.round(F.avg("temperature").over(w.rowsBetween(-7, -1)), 4),
    })
    return built.select(*KEYS, "demand", "demand_lag_7d", "temp_rolling_7d_mean")
