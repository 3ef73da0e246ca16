"""Lag, rolling, lookback and filter queries; positional bind; history rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions.calendar import calendar_features
from tidegrid.operators import history, lookback, rolling
from tidegrid.operators.splitting import split_at_date
from tidegrid.queries.base import (
    CALENDAR_SQL, HOURLY, SPLIT_DATE, SPLIT_SQL, WINDOW_SQL, hourly_events, hourly_sql, lag_sql, predictions,
    predictions_sql, query, r6, s6, shown, shown_sql,
)
from tidegrid.timeline import over_past

KEYS = ["series", "ts"]
L = 24


def _window(spark, folder, reach, build, names):
    return over_past(hourly_events(spark, folder), HOURLY, reach, build).select(*KEYS, *shown(names))


def _window_sql(*names: str) -> str:
    inner = ", ".join(f"{WINDOW_SQL[n]} AS {n}" for n in names)
    return hourly_sql() + f",\nf AS (SELECT series, ts, {inner} FROM hourly)\nSELECT series, ts, {shown_sql(names)} FROM f"


_LAGS = [f"demand_lag_{k}h" for k in (1, 2, 3, 24, 168)]
_WEATHER_LAGS = ["temp_lag_1h", "humidity_lag_1h", "wind_speed_lag_1h"]
_MEANS = [f"demand_rolling_{n}h_mean" for n in (3, 6, 12, 24)]
_EXTREMES = ["demand_rolling_24h_min", "demand_rolling_24h_max"]
_TEMPERATURE = ["temp_rolling_3h_mean", "temp_rolling_3h_std", "temp_rolling_24h_mean"]


@query("f01_demand_lags", _window_sql(*_LAGS))
def f01(spark, folder):
    return _window(spark, folder, rolling.LONGEST, rolling.demand_lags, _LAGS)


@query("f02_weather_lags", _window_sql(*_WEATHER_LAGS))
def f02(spark, folder):
    return _window(spark, folder, 1, rolling.weather_lags, _WEATHER_LAGS)


@query("f03_rolling_mean", _window_sql(*_MEANS))
def f03(spark, folder):
    return _window(spark, folder, 24, rolling.demand_means, _MEANS)


@query("f04_rolling_std", _window_sql("demand_rolling_24h_std"))
def f04(spark, folder):
    return _window(spark, folder, 24, rolling.demand_spread, ["demand_rolling_24h_std"])


@query("f05_rolling_extremes", _window_sql(*_EXTREMES))
def f05(spark, folder):
    return _window(spark, folder, 24, rolling.demand_extremes, _EXTREMES)


@query("f06_temperature_rolling", _window_sql(*_TEMPERATURE))
def f06(spark, folder):
    return _window(spark, folder, 24, rolling.temperature_rolling, _TEMPERATURE)


def _whole_numbers(spark, folder):
    return split_at_date(hourly_events(spark, folder).select("series", "ts", "date", "hour", "demand"), "date", SPLIT_DATE)


_WS = "PARTITION BY series, split ORDER BY ts"


@query("f07_lookback", hourly_sql() + f""",
s AS (SELECT series, ts, {SPLIT_SQL} AS split, demand, hour FROM hourly),
w AS (SELECT series, ts, split, demand AS target, row_number() OVER ({_WS}) AS rn,
        list(CAST(demand AS VARCHAR) || ':' || CAST(hour AS VARCHAR))
          OVER ({_WS} ROWS BETWEEN {L} PRECEDING AND 1 PRECEDING) AS items
      FROM s)
SELECT series, ts, split, target, CAST(len(items) AS INTEGER) AS length, array_to_string(items, ',') AS window_text
FROM w WHERE rn > {L}""")
def f07(spark, folder):
    windows = lookback.lookback(_whole_numbers(spark, folder), HOURLY, ["demand", "hour"], L)
    item = F.transform("sequence", lambda x: F.concat_ws(":", *[x[i].cast("bigint").cast("string") for i in (0, 1)]))
    return windows.select(
        *KEYS, "split", F.col("demand").alias("target"), F.size("sequence").alias("length"),
        F.array_join(item, ",").alias("window_text"))


@query("f08_point_features", hourly_sql() + f""",
s AS (SELECT series, ts, {SPLIT_SQL} AS split, demand, hour FROM hourly),
w AS (SELECT series, ts, split, demand AS target, row_number() OVER ({_WS}) AS rn,
        lag(demand) OVER ({_WS}) AS point_demand, lag(hour) OVER ({_WS}) AS point_hour FROM s)
SELECT series, ts, split, target, point_demand, point_hour FROM w WHERE rn > {L}""")
def f08(spark, folder):
    points = lookback.point_features(_whole_numbers(spark, folder), HOURLY, ["demand", "hour"], L)
    return points.select(*KEYS, "split", F.col("demand").alias("target"),
                         F.col("point.demand").alias("point_demand"), F.col("point.hour").alias("point_hour"))


_HISTORY_SQL = """,
history AS (
  SELECT model, CAST(day(date) AS INTEGER) AS epoch,
         CAST(sum(abs(actual - predicted)) AS DOUBLE) / count(*) AS val_loss
  FROM pred GROUP BY model, epoch)"""


def _history(spark, folder):
    """A loss per model and day, read as a training history: day n is epoch n."""
    error = F.abs(F.col("actual") - F.col("predicted"))
    return predictions(spark, folder, "event_type").groupBy("model", F.dayofmonth("date").alias("epoch")).agg(
        (F.sum(error).cast("double") / F.count(F.lit(1))).alias("val_loss"))


@query("f09_early_stop", predictions_sql("event_type") + _HISTORY_SQL + """,
a AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY epoch) AS n,
        min(val_loss) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM history),
b AS (SELECT *, before IS NULL OR val_loss < before AS better FROM a),
c AS (SELECT *, max(CASE WHEN better THEN n END) OVER (PARTITION BY model ORDER BY epoch
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_n FROM b),
d AS (SELECT *, min(CASE WHEN n - best_n >= 5 THEN n END) OVER (PARTITION BY model) AS stop_n FROM c)
SELECT model, max(epoch) AS stop_epoch, max(CASE WHEN better THEN epoch END) AS best_epoch,
       round(min(val_loss), 6) AS best_loss, max(CAST(n - best_n >= 5 AS INTEGER)) AS stopped_early
FROM d WHERE stop_n IS NULL OR n <= stop_n GROUP BY model""")
def f09(spark, folder):
    return history.early_stop(_history(spark, folder), patience=5).withColumn("best_loss", r6("best_loss"))


@query("g15_best_epoch", predictions_sql("event_type") + _HISTORY_SQL + """
SELECT model, arg_min(epoch, val_loss) AS best_epoch, round(min(val_loss), 6) AS best_loss
FROM (SELECT * FROM history ORDER BY epoch) GROUP BY model""")
def g15(spark, folder):
    return history.best_epoch(_history(spark, folder)).withColumn("best_loss", r6("best_loss"))


# the filter weights are quarters, so that their sums are exact in both engines
KERNELS = {2: (0.5, 0.5), 3: (0.25, 0.5, 0.25), 5: (0.125, 0.125, 0.25, 0.25, 0.25)}


def _filter_sql(weights, dilation: int) -> str:
    terms = []
    for back, weight in enumerate(reversed(weights)):
        value = "demand" if back == 0 else f"coalesce({lag_sql('demand', back * dilation)}, 0)"
        terms.append(f"CAST({weight} AS DOUBLE) * {value}")
    return " + ".join(terms)


_BANK_SQL = hourly_sql() + ",\nbank AS (SELECT series, ts, " + ", ".join(
    f"{_filter_sql(w, 2)} AS scale_{k}" for k, w in KERNELS.items()) + " FROM hourly)"


@query("f10_filter_bank", _BANK_SQL + """
SELECT series, ts, scale_2, scale_3, scale_5 FROM bank""")
def f10(spark, folder):
    bank = lookback.filter_bank(hourly_events(spark, folder), HOURLY, "demand", KERNELS, dilation=2)
    return bank.select(*KEYS, *[f"scale_{k}" for k in KERNELS])


@query("f10_stacked_filter", hourly_sql() + f""",
l0 AS (SELECT series, ts, 0.5e0 * demand + 0.5e0 * coalesce({lag_sql('demand', 1)}, 0) AS x FROM hourly),
l1 AS (SELECT series, ts, 0.5e0 * x + 0.5e0 * coalesce({lag_sql('x', 2)}, 0) AS x FROM l0)
SELECT series, ts, 0.5e0 * x + 0.5e0 * coalesce({lag_sql('x', 4)}, 0) AS filtered FROM l1""")
def f10_stacked(spark, folder):
    levels = [(0.5, 0.5)] * 3
    return lookback.stacked_filter(hourly_events(spark, folder), HOURLY, "demand", levels).select(*KEYS, "filtered")


_SHARE_SQL = _BANK_SQL + """,
m AS (SELECT avg(abs(scale_2)) AS a2, avg(abs(scale_3)) AS a3, avg(abs(scale_5)) AS a5 FROM bank),
shares AS (
  SELECT 2 AS kernel, a2 AS mean_abs, a2 / (a2 + a3 + a5) AS share FROM m
  UNION ALL SELECT 3, a3, a3 / (a2 + a3 + a5) FROM m
  UNION ALL SELECT 5, a5, a5 / (a2 + a3 + a5) FROM m)"""


@query("g16_scale_share", _SHARE_SQL + f"""
SELECT kernel, {s6('mean_abs')}, {s6('share')},
       {s6('exp(mean_abs) / sum(exp(mean_abs)) OVER ()', 'weight')} FROM shares""")
def g16(spark, folder):
    bank = lookback.filter_bank(hourly_events(spark, folder), HOURLY, "demand", KERNELS, dilation=2)
    weighted = lookback.softmax_weights(lookback.scale_share(bank, list(KERNELS)), "mean_abs", [])
    return weighted.select("kernel", r6("mean_abs"), r6("share"), r6("weight"))


@query("j01_column_bind", hourly_sql() + f"""
SELECT series, ts, {WINDOW_SQL['demand_lag_1h']} AS demand_lag_1h, {WINDOW_SQL['demand_lag_24h']} AS demand_lag_24h,
       {CALENDAR_SQL['day_of_week']} AS day_of_week, {CALENDAR_SQL['is_rush_hour']} AS is_rush_hour
FROM hourly""")
def j01(spark, folder):
    raw = hourly_events(spark, folder)
    left = over_past(raw, HOURLY, 24, rolling.demand_lags).select(*KEYS, "demand_lag_1h", "demand_lag_24h")
    right = raw.withColumns(calendar_features()).select(
        *KEYS, "day_of_week", "is_rush_hour")
    return left.join(right, KEYS)


@query("hot_series_lags", hourly_sql("event_type") + f"""
SELECT series, ts, {WINDOW_SQL['demand_lag_168h']} AS demand_lag_168h,
       {s6(WINDOW_SQL['demand_rolling_24h_mean'], 'demand_rolling_24h_mean')}
FROM hourly""")
def hot_series(spark, folder):
    # blocks shorter than the reach: the halo then spans several blocks
    built = over_past(hourly_events(spark, folder, "event_type"), HOURLY.at(block=50), rolling.LONGEST, lambda w: {
        "demand_lag_168h": F.lag("demand", 168).over(w),
        "demand_rolling_24h_mean": F.avg("demand").over(rolling.past(w, 24))})
    return built.select(*KEYS, "demand_lag_168h", r6("demand_rolling_24h_mean"))
