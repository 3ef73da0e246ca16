"""Registry, shared inputs and shared SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.splitting import split_at_date
from tidegrid.sources.adapters import DAILY, HOURLY, daily_orders, hourly_events
from tidegrid.timeline import over_past

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SPLIT_DATE = "2024-01-25"

__all__ = ["DAILY", "HOURLY", "daily_orders", "hourly_events"]


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return keep


def r6(column: Column | str, name: str | None = None) -> Column:
    out = F.round(F.col(column) if isinstance(column, str) else column, 6)
    return out.alias(name or (column if isinstance(column, str) else None))


def s6(expression: str, name: str | None = None, digits: int = 6) -> str:
    """SQL twin of ``r6``; adding zero turns -0.0 into 0.0."""
    return f"round({expression}, {digits}) + 0.0 AS {name or expression}"


def hourly_sql(series: str = "user_id") -> str:
    """CTEs up to ``hourly``; a query follows."""
    return f"""
WITH ev AS (
  SELECT {series} AS series, date_trunc('hour', ts) AS hr,
         CAST(value AS DECIMAL(18,2)) AS v, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
cell AS (
  SELECT series, hr, count(*) AS n, sum(v) AS sv, max(v) AS hi, min(v) AS lo, sum(k) AS sk,
         count(*) FILTER (WHERE k >= 90) AS wet, count(*) FILTER (WHERE k <= 3) AS white
  FROM ev GROUP BY series, hr),
span AS (SELECT min(hr) AS a, max(hr) AS b FROM ev),
grid AS (
  SELECT s.series, t.hr
  FROM (SELECT DISTINCT series FROM ev) s
  CROSS JOIN (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hr FROM span) t),
measured AS (
  SELECT g.series, g.hr AS ts, CAST(g.hr AS DATE) AS date, CAST(hour(g.hr) AS INTEGER) AS hour,
         coalesce(n, 0) AS demand,
         coalesce(CAST(sv AS DOUBLE) / n, 0.0) AS temperature,
         coalesce(CAST(sk AS DOUBLE) / n, 50.0) AS humidity,
         coalesce(CAST(hi - lo AS DOUBLE), 0.0) AS wind_speed,
         coalesce(CAST(sv * 10 AS DOUBLE), 2000.0) AS visibility,
         coalesce(CAST(lo AS DOUBLE), 0.0) AS solar,
         CAST(coalesce(wet, 0) AS DOUBLE) AS rainfall,
         CAST(coalesce(white, 0) AS DOUBLE) AS snowfall
  FROM grid g LEFT JOIN cell c ON g.series = c.series AND g.hr = c.hr),
hourly AS (
  SELECT *, temperature - (100 - humidity) / 5 AS dew_point,
         CASE WHEN day(ts) <= 7 THEN 'Winter' WHEN day(ts) <= 14 THEN 'Spring'
              WHEN day(ts) <= 21 THEN 'Summer' ELSE 'Autumn' END AS season,
         CASE WHEN day(ts) IN (1, 15) THEN 'Holiday' ELSE 'No Holiday' END AS holiday,
         CASE WHEN hour = 3 THEN 'No' ELSE 'Yes' END AS functioning
  FROM measured)"""


DAILY_SQL = """
WITH od AS (
  SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18,2)) AS v
  FROM orders),
cell AS (SELECT series, d, count(*) AS n, sum(v) AS sv FROM od GROUP BY series, d),
span AS (SELECT min(d) AS a, max(d) AS b FROM od),
grid AS (
  SELECT s.series, t.d
  FROM (SELECT DISTINCT series FROM od) s
  CROSS JOIN (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM span) t),
daily AS (
  SELECT g.series, CAST(g.d AS TIMESTAMP) AS ts, g.d AS date, coalesce(n, 0) AS demand,
         coalesce(CAST(sv AS DOUBLE) / n, 0.0) AS temperature
  FROM grid g LEFT JOIN cell c ON g.series = c.series AND g.d = c.d)"""

_W = "PARTITION BY series ORDER BY ts"


def lag_sql(column: str, k: int) -> str:
    return f"lag({column}, {k}) OVER ({_W})"


def past_sql(function: str, column: str, n: int) -> str:
    return f"{function}({column}) OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


SPLIT_SQL = f"CASE WHEN date < DATE '{SPLIT_DATE}' THEN 'train' ELSE 'test' END"

CALENDAR_SQL = {
    "day_of_week": "CAST(isodow(date) - 1 AS INTEGER)",
    "month": "CAST(month(date) AS INTEGER)",
    "day_of_month": "CAST(day(date) AS INTEGER)",
    "is_weekend": "CAST(isodow(date) >= 6 AS INTEGER)",
    "is_weekday": "CAST(isodow(date) < 6 AS INTEGER)",
    "hour_sin": "sin(2 * pi() * hour / 24)",
    "hour_cos": "cos(2 * pi() * hour / 24)",
    "day_of_week_sin": "sin(2 * pi() * (isodow(date) - 1) / 7)",
    "day_of_week_cos": "cos(2 * pi() * (isodow(date) - 1) / 7)",
    "month_sin": "sin(2 * pi() * month(date) / 12)",
    "month_cos": "cos(2 * pi() * month(date) / 12)",
    "is_morning_rush": "CAST(hour IN (7, 8, 9) AS INTEGER)",
    "is_evening_rush": "CAST(hour IN (17, 18, 19) AS INTEGER)",
    "is_rush_hour": "CAST(hour IN (7, 8, 9, 17, 18, 19) AS INTEGER)",
    "time_of_day_night": "CAST(hour BETWEEN 0 AND 5 AS INTEGER)",
    "time_of_day_morning": "CAST(hour BETWEEN 6 AND 11 AS INTEGER)",
    "time_of_day_afternoon": "CAST(hour BETWEEN 12 AND 17 AS INTEGER)",
    "time_of_day_evening": "CAST(hour BETWEEN 18 AND 23 AS INTEGER)",
    "is_work_hour": "CAST(hour BETWEEN 8 AND 18 AND isodow(date) < 6 AS INTEGER)",
}
WINDOW_SQL = {
    **{f"demand_lag_{k}h": lag_sql("demand", k) for k in (1, 2, 3, 24, 168)},
    "temp_lag_1h": lag_sql("temperature", 1),
    "humidity_lag_1h": lag_sql("humidity", 1),
    "wind_speed_lag_1h": lag_sql("wind_speed", 1),
    **{f"demand_rolling_{n}h_mean": past_sql("avg", "demand", n) for n in (3, 6, 12, 24)},
    "demand_rolling_24h_std": past_sql("stddev_samp", "demand", 24),
    "demand_rolling_24h_min": past_sql("min", "demand", 24),
    "demand_rolling_24h_max": past_sql("max", "demand", 24),
    "temp_rolling_3h_mean": past_sql("avg", "temperature", 3),
    "temp_rolling_3h_std": past_sql("stddev_samp", "temperature", 3),
    "temp_rolling_24h_mean": past_sql("avg", "temperature", 24),
    "temp_change_1h": f"temperature - {lag_sql('temperature', 1)}",
    "humidity_change_1h": f"humidity - {lag_sql('humidity', 1)}",
    "wind_speed_change_1h": f"wind_speed - {lag_sql('wind_speed', 1)}",
}
INTERACTION_SQL = {
    "temp_x_hour": "temperature * hour",
    "temp_x_is_rush_hour": "temperature * CAST(hour IN (7, 8, 9, 17, 18, 19) AS INTEGER)",
    "temp_squared": "temperature * temperature",
    "is_comfortable_weather": "CAST(temperature > 10 AND temperature < 25 AND humidity < 70 AS INTEGER)",
    "has_rain": "CAST(rainfall > 0 AS INTEGER)",
    "has_snow": "CAST(snowfall > 0 AS INTEGER)",
    "has_precipitation": "CAST(rainfall > 0 OR snowfall > 0 AS INTEGER)",
    "low_visibility": "CAST(visibility < 1000 AS INTEGER)",
    "bad_weather": "CAST(rainfall > 0 OR snowfall > 0 OR visibility < 1000 AS INTEGER)",
    "wind_chill": "temperature - wind_speed * CAST(0.7 AS DOUBLE)",
    "apparent_temp": "temperature - CAST(0.4 AS DOUBLE) * (temperature - 10) * (1 - humidity / 100)",
}
ENCODING_SQL = {
    "Season_Spring": "CAST(season = 'Spring' AS INTEGER)",
    "Season_Summer": "CAST(season = 'Summer' AS INTEGER)",
    "Season_Winter": "CAST(season = 'Winter' AS INTEGER)",
    "is_holiday": "CAST(holiday = 'Holiday' AS INTEGER)",
    "is_functioning": "CAST(functioning = 'Yes' AS INTEGER)",
}
FEATURE_SQL = CALENDAR_SQL | WINDOW_SQL | INTERACTION_SQL | ENCODING_SQL
INTEGER_FEATURES = {
    n for n in FEATURE_SQL
    if n.startswith(("is_", "has_", "time_of_day", "Season_", "demand_lag")) or n in (
        "day_of_week", "month", "day_of_month", "low_visibility", "bad_weather",
        "demand_rolling_24h_min", "demand_rolling_24h_max")
}


def features_sql(source: str = "hourly", name: str = "feat") -> str:
    """CTE with the complete feature table, unrounded, after ``hourly_sql()``."""
    columns = ",\n  ".join(f"{e} AS {n}" for n, e in FEATURE_SQL.items())
    return f",\n{name} AS (SELECT *, demand AS target, {SPLIT_SQL} AS split,\n  {columns}\n  FROM {source})"


def shown(names, digits: int = 6) -> list[Column]:
    plain = INTEGER_FEATURES | {"demand", "target"}
    return [F.expr(n if n in plain else f"round({n}, {digits}) AS {n}") for n in names]


def shown_sql(names, digits: int = 6) -> str:
    return ", ".join(n if n in INTEGER_FEATURES or n in ("demand", "target") else s6(n, digits=digits) for n in names)


def predictions(spark: SparkSession, folder: str, series: str = "user_id") -> DataFrame:
    """Two predictors that need no model: the last hour, and the same hour a day before."""
    raw = hourly_events(spark, folder, series).select("series", "ts", "date", F.col("demand").alias("actual"))
    lagged = over_past(raw, HOURLY, 24, lambda w: {
        "persistence": F.lag("actual", 1).over(w), "seasonal": F.lag("actual", 24).over(w)})
    models = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in ("persistence", "seasonal")]))
    long = split_at_date(lagged, "date", SPLIT_DATE).select("series", "ts", "date", "split", "actual", models.alias("m"))
    return long.select("series", "ts", "date", "split", "actual", "m.*").where(F.col("predicted").isNotNull())


def predictions_sql(series: str = "user_id") -> str:
    return hourly_sql(series) + f""",
lagged AS (
  SELECT series, ts, date, {SPLIT_SQL} AS split, demand AS actual,
         {lag_sql('demand', 1)} AS p1, {lag_sql('demand', 24)} AS p24 FROM hourly),
pred AS (
  SELECT series, ts, date, split, actual, 'persistence' AS model, p1 AS predicted FROM lagged WHERE p1 IS NOT NULL
  UNION ALL
  SELECT series, ts, date, split, actual, 'seasonal', p24 FROM lagged WHERE p24 IS NOT NULL)"""


METRIC_SQL = {
    "R2": "1 - sum((actual - predicted) * (actual - predicted)) / nullif(count(*) * var_pop(actual), 0)",
    "RMSE": "sqrt(avg((actual - predicted) * (actual - predicted)))",
    "MAE": "avg(abs(actual - predicted))",
    "CV": "100 * sqrt(avg((actual - predicted) * (actual - predicted))) / nullif(avg(actual), 0)",
    "MAPE": "avg(CASE WHEN actual <> 0 THEN abs(actual - predicted) / CAST(actual AS DOUBLE) * 100 END)",
}


def metrics_sql(by: str = "model, split", source: str = "pred") -> str:
    """CTE ``scores`` with the five metrics, after ``predictions_sql()``."""
    columns = ", ".join(f"{e} AS {n}" for n, e in METRIC_SQL.items())
    return f",\nscores AS (SELECT {by}, {columns} FROM {source} GROUP BY {by})"
