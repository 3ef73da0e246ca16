"""Quality, describe, correlation, scaling and leak queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tidegrid.columns import CALENDAR, FEATURES, LAGS, WEATHER
from tidegrid.operators import correlation, quality, quantiles, scaling
from tidegrid.operators.rolling import window_features
from tidegrid.operators.splitting import split_at_date
from tidegrid.plans.features import feature_table, model_table
from tidegrid.queries.base import (
    HOURLY, SPLIT_DATE, SPLIT_SQL, WINDOW_SQL, features_sql, hourly_events, hourly_sql, query, r6, s6,
)
from tidegrid.timeline import over_past

KEYS = ["series", "ts"]
FEAT = hourly_sql() + features_sql()


def _features(spark, folder):
    return split_at_date(feature_table(hourly_events(spark, folder), HOURLY), "date", SPLIT_DATE)


def _unpivot(select: str, names) -> str:
    return "\nUNION ALL ".join(select.format(c=c) for c in names)


@query("g01_missing_counts", FEAT + ",\nc AS (" + _unpivot(
    "SELECT '{c}' AS column_name, count(*) AS total, count(*) FILTER ({c} IS NULL) AS missing FROM feat", FEATURES
) + f")\nSELECT column_name, missing, {s6('100.0e0 * missing / total', 'percent')} FROM c WHERE missing > 0")
def g01(spark, folder):
    return quality.missing_counts(_features(spark, folder), FEATURES).select("column_name", "missing", r6("percent"))


@query("g02_drop_incomplete", FEAT + ",\nn AS (SELECT count(*) AS total_rows, count(*) FILTER (" + " OR ".join(
    f"{c} IS NULL" for c in FEATURES
) + f""") AS dropped_rows FROM feat)
SELECT total_rows, dropped_rows, total_rows - dropped_rows AS kept_rows,
       {s6('100.0e0 * dropped_rows / total_rows', 'dropped_percent')} FROM n""")
def g02(spark, folder):
    counts = quality.incomplete_rows(_features(spark, folder), FEATURES)
    return counts.withColumn("dropped_percent", r6("dropped_percent"))


# ln of a zero demand is minus infinity: a column where the check has work to do
_LOG_SQL = hourly_sql() + f""",
f AS (SELECT series, ts, demand, temperature,
        CASE WHEN demand > 0 THEN ln(demand) ELSE CAST('-Infinity' AS DOUBLE) END AS log_demand,
        {WINDOW_SQL['temp_lag_1h']} AS temp_lag_1h, {SPLIT_SQL} AS split FROM hourly)"""


def _with_log(spark, folder):
    raw = over_past(hourly_events(spark, folder), HOURLY, 1, lambda w: {"temp_lag_1h": F.lag("temperature", 1).over(w)})
    log = F.when(F.col("demand") > 0, F.log("demand")).otherwise(F.lit(float("-inf")))
    return split_at_date(raw, "date", SPLIT_DATE).withColumn("log_demand", log)


@query("g03_infinity_counts", _LOG_SQL + """
SELECT 'log_demand' AS column_name, count(*) FILTER (isinf(log_demand)) AS infinite FROM f""")
def g03(spark, folder):
    return quality.infinity_counts(_with_log(spark, folder))


@query("g04_drop_infinite", _LOG_SQL + f"""
SELECT series, ts, demand, {s6('log_demand')} FROM f WHERE NOT isinf(log_demand) AND temp_lag_1h IS NOT NULL""")
def g04(spark, folder):
    kept = quality.drop_infinite(_with_log(spark, folder))
    return kept.select(*KEYS, "demand", r6("log_demand"))


@query("g05_split_totals", _LOG_SQL + """
SELECT split, CAST(sum(CAST(temp_lag_1h IS NULL AS INTEGER)) AS BIGINT) AS missing,
       CAST(sum(CAST(isinf(log_demand) AS INTEGER)) AS BIGINT) AS infinite
FROM f GROUP BY split""")
def g05(spark, folder):
    return quality.split_totals(_with_log(spark, folder))


@query("g06_split_consistency", _LOG_SQL + """,
train AS (SELECT count(*) AS n, count(temp_lag_1h) AS k FROM f WHERE split = 'train'),
test AS (SELECT count(*) AS n, count(temp_lag_1h) AS k FROM f WHERE split = 'test')
SELECT 'demand' AS column_name, 1 AS in_train, 1 AS in_test, a.n AS train_values, b.n AS test_values FROM train a, test b
UNION ALL SELECT 'temp_lag_1h', 1, 1, a.k, b.k FROM train a, test b
UNION ALL SELECT 'temperature', 1, 0, a.n, 0 FROM train a
UNION ALL SELECT 'log_demand', 0, 1, 0, b.n FROM test b""")
def g06(spark, folder):
    rows = _with_log(spark, folder)
    train = rows.where("split = 'train'").select("demand", "temp_lag_1h", "temperature")
    test = rows.where("split = 'test'").select("demand", "temp_lag_1h", "log_demand")
    return quality.split_consistency(train, test)


@query("g07_shape", FEAT + f""",
n AS (SELECT count(*) AS raw, count(*) FILTER (demand_lag_168h IS NOT NULL) AS kept,
  count(*) FILTER (demand_lag_168h IS NOT NULL AND split = 'train') AS train,
  count(*) FILTER (demand_lag_168h IS NOT NULL AND split = 'test') AS test FROM feat),
s AS (SELECT 'raw' AS stage, raw AS row_count, 16 AS column_count, raw AS whole FROM n
  UNION ALL SELECT 'complete', kept, 69, raw FROM n
  UNION ALL SELECT 'train', train, 69, raw FROM n
  UNION ALL SELECT 'test', test, 69, raw FROM n)
SELECT stage, row_count, column_count, {s6('100.0e0 * row_count / whole', 'retained_percent')} FROM s""")
def g07(spark, folder):
    raw = hourly_events(spark, folder)
    table = model_table(raw, HOURLY, SPLIT_DATE)
    halves = {half: ("complete", f"split = '{half}'") for half in ("train", "test")}
    return quality.shapes({"raw": raw, "complete": table}, "raw", halves).withColumn("retained_percent", r6("retained_percent"))


def _describe_sql(column: str, by: str) -> str:
    return f"""
SELECT {by}, count({column}) AS "count", {s6(f'avg({column})', 'mean')}, {s6(f'stddev_samp({column})', 'std')},
       {s6(f'CAST(min({column}) AS DOUBLE)', '"min"')}, {s6(f'quantile_cont({column}, 0.25)', 'q25')},
       {s6(f'quantile_cont({column}, 0.5)', 'q50')}, {s6(f'quantile_cont({column}, 0.75)', 'q75')},
       {s6(f'CAST(max({column}) AS DOUBLE)', '"max"')}"""


_DESCRIBED = ["mean", "std", "min", "q25", "q50", "q75", "max"]


@query("g08_describe", hourly_sql() + ",\nf AS (SELECT *, CAST(demand AS DOUBLE) AS y, " + SPLIT_SQL
       + " AS split FROM hourly)" + _describe_sql("y", "split") + " FROM f GROUP BY split")
def g08(spark, folder):
    rows = split_at_date(hourly_events(spark, folder), "date", SPLIT_DATE)
    out = quantiles.describe(rows, "demand", ["split"])
    return out.select("split", "count", *[r6(c) for c in _DESCRIBED])


@query("g08_describe_prices", """
WITH p AS (SELECT o_orderstatus AS status, o_totalprice AS price FROM orders)"""
       + _describe_sql("price", "status") + " FROM p GROUP BY status")
def g08_prices(spark, folder):
    from tidegrid.sources.adapters import read_table

    rows = read_table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return quantiles.describe(rows, "price", ["status"]).select("status", "count", *[r6(c) for c in _DESCRIBED])


def _corr_sql(names, where: str = "") -> str:
    pairs = list(combinations(names, 2))
    wide = ", ".join(f"corr({a}, {b}) AS r{i}" for i, (a, b) in enumerate(pairs))
    rows = "\nUNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", r{i} AS r FROM wide" for i, (a, b) in enumerate(pairs))
    return FEAT + f""",
wide AS (SELECT {wide} FROM feat),
pairs AS ({rows}),
safe AS (SELECT "left", "right", CASE WHEN isnan(r) THEN NULL ELSE abs(r) END AS r FROM pairs)
SELECT "left", "right", {s6('r', 'correlation')} FROM safe {where}"""


_NARROW = [*WEATHER, *LAGS]
_WIDE = [*WEATHER, *LAGS, "month", "day_of_week", "temp_squared", "wind_chill", "apparent_temp",
         "temp_rolling_24h_mean", "demand_rolling_24h_std", "hour_sin"]


@query("g09_correlation", _corr_sql(_NARROW))
def g09(spark, folder):
    pairs = correlation.correlation_pairs(_features(spark, folder), _NARROW)
    return pairs.select("left", "right", r6("correlation"))


@query("g09_correlation_wide", _corr_sql(_WIDE))
def g09_wide(spark, folder):
    pairs = correlation.correlation_pairs(_features(spark, folder), _WIDE)
    return pairs.select("left", "right", r6("correlation"))


@query("g10_correlated_pairs", _corr_sql(_NARROW, "WHERE r > 0.90"))
def g10(spark, folder):
    pairs = correlation.correlation_pairs(_features(spark, folder), _NARROW)
    return correlation.correlated_pairs(pairs, 0.90).select("left", "right", r6("correlation"))


@query("g11_drop_correlated", hourly_sql() + """,
r AS (SELECT greatest(abs(corr(dew_point, temperature)), abs(corr(dew_point, humidity)), abs(corr(dew_point, solar))) AS r
      FROM hourly)
SELECT series, ts, round(temperature, 6) AS temperature, round(humidity, 6) AS humidity, solar,
       CAST((SELECT r > 0.70 FROM r) AS INTEGER) AS dew_point_dropped
FROM hourly""")
def g11(spark, folder):
    rows = hourly_events(spark, folder).select(*KEYS, "temperature", "humidity", "solar", "dew_point")
    kept, dropped = correlation.drop_correlated(
        rows, ["temperature", "humidity", "solar", "dew_point"], 0.70, drop_first=["dew_point"])
    return kept.select(*KEYS, r6("temperature"), r6("humidity"), "solar",
                       F.lit(int("dew_point" in dropped)).alias("dew_point_dropped"))


_SCALED = ["temperature", "humidity", "visibility", "demand", "month_number"]
_SCALE_SQL = hourly_sql() + f""",
f AS (SELECT *, CAST(month(date) AS DOUBLE) AS month_number, {SPLIT_SQL} AS split FROM hourly),
stats AS (""" + "\nUNION ALL ".join(
    f"""SELECT '{c}' AS feature, avg({c}) AS mean,
      CASE WHEN stddev_pop({c}) = 0 THEN 1.0e0 ELSE stddev_pop({c}) END AS scale FROM f WHERE split = 'train'"""
    for c in _SCALED) + ")"


def _scale_input(spark, folder):
    rows = hourly_events(spark, folder).withColumn("month_number", F.month("date").cast("double"))
    return split_at_date(rows, "date", SPLIT_DATE)


@query("g12_scaler_fit", _SCALE_SQL + f"""
SELECT feature, {s6('mean')}, {s6('scale')} FROM stats""")
def g12(spark, folder):
    stats = scaling.fit_scaler(_scale_input(spark, folder).where("split = 'train'"), _SCALED)
    return stats.select("feature", r6("mean"), r6("scale"))


@query("g12_scaler_per_series", hourly_sql() + f"""
SELECT series, 'temperature' AS feature, {s6('avg(temperature)', 'mean', 9)},
       {s6('CASE WHEN stddev_pop(temperature) = 0 THEN 1.0e0 ELSE stddev_pop(temperature) END', 'scale', 9)}
FROM hourly WHERE {SPLIT_SQL} = 'train' GROUP BY series""")
def g12_series(spark, folder):
    stats = scaling.fit_scaler(_scale_input(spark, folder).where("split = 'train'"), ["temperature"], ["series"])
    return stats.select("series", "feature", F.round("mean", 9).alias("mean"), F.round("scale", 9).alias("scale"))


def _z_sql(column: str) -> str:
    return f"(f.{column} - (SELECT mean FROM stats WHERE feature = '{column}')) / (SELECT scale FROM stats WHERE feature = '{column}')"


@query("g13_scale_and_back", _SCALE_SQL + f"""
SELECT series, ts, split, {', '.join(s6(_z_sql(c), f'{c}_scaled') for c in ('temperature', 'humidity', 'demand'))},
       CAST(demand AS DOUBLE) AS demand_back
FROM f""")
def g13(spark, folder):
    rows = _scale_input(spark, folder)
    names = ["temperature", "humidity", "demand"]
    stats = scaling.fit_scaler(rows.where("split = 'train'"), names)
    scaled = scaling.transform(rows, stats, names).withColumn("demand_back", F.col("demand"))
    back = scaling.inverse(scaled, stats, {"demand_back": "demand"})
    return back.select(*KEYS, "split", *[r6(c, f"{c}_scaled") for c in names], r6("demand_back"))


@query("g20_leak_guard", hourly_sql() + f""",
f AS (SELECT demand, demand AS renamed_copy, temperature, {WINDOW_SQL['demand_lag_1h']} AS demand_lag_1h FROM hourly)
SELECT 'Demand' AS feature, 1 AS name_leak, 1 AS value_leak, 1 AS leaked
UNION ALL SELECT 'renamed_copy', 0, CAST(bool_and(renamed_copy IS NOT DISTINCT FROM demand) AS INTEGER),
  CAST(bool_and(renamed_copy IS NOT DISTINCT FROM demand) AS INTEGER) FROM f
UNION ALL SELECT 'temperature', 0, CAST(bool_and(temperature IS NOT DISTINCT FROM demand) AS INTEGER),
  CAST(bool_and(temperature IS NOT DISTINCT FROM demand) AS INTEGER) FROM f
UNION ALL SELECT 'demand_lag_1h', 0, CAST(bool_and(demand_lag_1h IS NOT DISTINCT FROM demand) AS INTEGER),
  CAST(bool_and(demand_lag_1h IS NOT DISTINCT FROM demand) AS INTEGER) FROM f""")
def g20(spark, folder):
    rows = over_past(hourly_events(spark, folder), HOURLY, 1, lambda w: {"demand_lag_1h": F.lag("demand", 1).over(w)})
    rows = rows.select(F.col("demand").alias("target"), F.col("demand").alias("Demand"),
                       F.col("demand").alias("renamed_copy"), "temperature", "demand_lag_1h")
    return quality.leaks(rows, ["Demand", "renamed_copy", "temperature", "demand_lag_1h"])
