"""Sources and sinks: each query writes a table and returns what is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.columns import FEATURES, RAW_HEADER, REPLACED
from tidegrid.operators import metrics, scaling
from tidegrid.operators.splitting import split_at_date
from tidegrid.plans.features import model_table
from tidegrid.queries.base import (
    DAILY_SQL, HOURLY, SPLIT_DATE, SPLIT_SQL, daily_orders, features_sql, hourly_events, hourly_sql,
    metrics_sql, predictions, predictions_sql, query, r6, s6, shown, shown_sql,
)
from tidegrid.session import scratch_path
from tidegrid.sinks import reports, tables
from tidegrid.sources import csv, results

_BARE = ["series", "date", *[c for c in RAW_HEADER.values() if c != "date"]]
_RAW_SQL = hourly_sql() + """
SELECT series, date, demand, hour, round(temperature, 6) AS temperature, round(humidity, 6) AS humidity, wind_speed,
       visibility, round(dew_point, 6) + 0.0 AS dew_point, solar, rainfall, snowfall, season, holiday, functioning
FROM hourly"""


def _raw(spark, folder):
    raw = hourly_events(spark, folder).select(*_BARE)
    return raw.withColumns({c: r6(c) for c in ("temperature", "humidity", "dew_point")})


@query("a01_csv_encoding_fallback", _RAW_SQL)
def a01(spark, folder):
    path = tables.write_raw_csv(_raw(spark, folder), scratch_path(spark, "raw"), encoding="ISO-8859-1")
    return csv.read_raw_csv(spark, path, {"series": "bigint"}).select(*_BARE)


def _pair_schema(df) -> str:
    types = {f.name: "boolean" if f.name.startswith("Season_") else f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{n}` {t}" for n, t in types.items())


_TABLE_SQL = hourly_sql() + features_sql() + f"""
SELECT split, target, {shown_sql(['demand', *FEATURES])} FROM feat WHERE demand_lag_168h IS NOT NULL"""


def _engineered(spark, folder):
    table = model_table(hourly_events(spark, folder), HOURLY, SPLIT_DATE)
    return table.select("split", "target", *shown(["demand", *FEATURES]))


@query("a02_feature_pair_scan", _TABLE_SQL)
def a02(spark, folder):
    table = _engineered(spark, folder)
    train_path, test_path = tables.write_split_csv(table, scratch_path(spark, "pair"))
    train, test = csv.read_feature_pair(spark, train_path, test_path, _pair_schema(table.drop("split")))
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.select(*table.columns)


@query("a03_typed_csv_scan", DAILY_SQL + """
SELECT demand AS "Count", date AS "Date", CAST(year(date) AS INTEGER) AS "Year", CAST(month(date) AS INTEGER) AS "Month",
       CAST(day(date) AS INTEGER) AS "Day", round(temperature, 4) AS "Price", series AS "Season"
FROM daily""")
def a03(spark, folder):
    tidy = daily_orders(spark, folder).select(
        F.col("demand").alias("Count"), F.date_format("date", "yyyy-MM-dd").alias("Date"),
        F.year("date").alias("Year"), F.month("date").alias("Month"), F.dayofmonth("date").alias("Day"),
        F.round("temperature", 4).alias("Price"), F.col("series").alias("Season"))
    path = scratch_path(spark, "tidy")
    tidy.write.options(header=True).csv(path)
    return csv.read_typed_csv(
        spark, path, "Count bigint, Date string, Year int, Month int, Day int, Price double, Season string", "Date")


def _documents(spark, folder):
    scored = metrics.evaluate(predictions(spark, folder))
    return reports.metrics_documents(scored, ["demand_lag_1h", "demand_lag_24h"], {"lookback": "24"})


_NESTED_SQL = predictions_sql() + metrics_sql() + """,
wide AS (SELECT model,
  max(CASE WHEN split = 'train' THEN R2 END) AS train_r2, max(CASE WHEN split = 'train' THEN RMSE END) AS train_rmse,
  max(CASE WHEN split = 'train' THEN MAE END) AS train_mae, max(CASE WHEN split = 'train' THEN CV END) AS train_cv,
  max(CASE WHEN split = 'test' THEN R2 END) AS test_r2, max(CASE WHEN split = 'test' THEN RMSE END) AS test_rmse,
  max(CASE WHEN split = 'test' THEN MAE END) AS test_mae, max(CASE WHEN split = 'test' THEN MAPE END) AS test_mape
  FROM scores GROUP BY model)"""


@query("a04_leaderboard_scan", _NESTED_SQL + f"""
SELECT model AS model_name, CAST(rank() OVER (ORDER BY test_r2 DESC) AS INTEGER) AS "rank", '0' AS parameters,
       {', '.join(s6(c) for c in ('train_r2', 'train_rmse', 'train_mae', 'test_r2', 'test_rmse', 'test_mae'))}
FROM wide""")
def a04(spark, folder):
    nested = _documents(spark, folder).withColumn("test_r2", F.col("test_metrics.R2")).withColumn("parameters", F.lit(0))
    path = scratch_path(spark, "leaderboard")
    reports.write_json(reports.leaderboard_documents(metrics.rank_models(nested)), path)
    board = results.read_leaderboard(spark, path)
    scores = [r6(f"{s}_metrics.{m}", f"{s}_{m.lower()}") for s in ("train", "test") for m in ("R2", "RMSE", "MAE")]
    return board.select("model_name", "rank", "parameters", *scores)


@query("b01_split_csv", _TABLE_SQL)
def b01(spark, folder):
    table = _engineered(spark, folder)
    paths = tables.write_split_csv(table, scratch_path(spark, "csv"))
    train, test = csv.read_feature_pair(spark, *paths, _pair_schema(table.drop("split")))
    halves = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return halves.select(*table.columns)


@query("b01_split_parquet", _TABLE_SQL)
def b01_parquet(spark, folder):
    table = _engineered(spark, folder)
    path = tables.write_split_parquet(table, scratch_path(spark, "parquet"))
    return spark.read.parquet(path).select(*table.columns)


def _header(name: str) -> str:
    return {ours: theirs for theirs, ours in RAW_HEADER.items()}.get(name, name)


@query("b02_manifest", hourly_sql() + features_sql() + ",\nn AS (" + "\nUNION ALL ".join(
    f"SELECT '{_header(c)}' AS feature, count({c}) AS value_count FROM feat WHERE demand_lag_168h IS NOT NULL"
    for c in FEATURES) + ")\nSELECT feature, value_count FROM n")
def b02(spark, folder):
    table = model_table(hourly_events(spark, folder), HOURLY, SPLIT_DATE)
    path = scratch_path(spark, "manifest")
    names = tables.write_manifest(table, path, ["series", "ts", "split"])
    counts = table.agg(*[F.count(n).alias(f"_c{i}") for i, n in enumerate(names)]).select(F.explode(F.array(*[
        F.struct(F.lit(_header(n)).alias("feature"), F.col(f"_c{i}").alias("value_count")) for i, n in enumerate(names)
    ])).alias("_row")).select("_row.*")
    return spark.read.text(path).withColumnRenamed("value", "feature").join(counts, "feature")


@query("b03_feature_report", hourly_sql() + features_sql() + f""",
k AS (SELECT * FROM feat WHERE demand_lag_168h IS NOT NULL),
p AS (SELECT split, count(*) AS n, min(date) AS a, max(date) AS b FROM k GROUP BY split)
SELECT 'summary' AS section, split || '_rows' AS key, CAST(n AS VARCHAR) AS value FROM p
UNION ALL SELECT 'dates', split || '_range', CAST(a AS VARCHAR) || ' to ' || CAST(b AS VARCHAR) FROM p
UNION ALL SELECT 'quality', split || '_missing', '0' FROM p
UNION ALL SELECT 'quality', split || '_infinite', '0' FROM p
UNION ALL SELECT 'summary', 'original_rows', CAST(count(*) AS VARCHAR) FROM hourly
UNION ALL SELECT 'summary', 'original_columns', '16'
UNION ALL SELECT 'summary', 'rows_dropped', CAST((SELECT count(*) FROM hourly) - count(*) AS VARCHAR) FROM k
UNION ALL SELECT 'summary', 'features', '{len(FEATURES)}'
UNION ALL SELECT 'dropped', 'correlated', 'none'
UNION ALL SELECT 'dropped', 'originals', '{", ".join(REPLACED)}'
""" + "\n".join(f"UNION ALL SELECT 'feature', '{i:03d}', '{c}'" for i, c in enumerate(FEATURES, 1)))
def b03(spark, folder):
    raw = hourly_events(spark, folder)
    complete = model_table(raw, HOURLY, SPLIT_DATE, keep_originals=True)
    report = reports.feature_report(raw, complete, FEATURES, (), REPLACED)
    json_path, _ = reports.write_report(report, scratch_path(spark, "report"))
    return spark.read.schema("section string, key string, value string").json(json_path)


@query("b04_metrics_json", _NESTED_SQL + f"""
SELECT model, {', '.join(s6(c) for c in ('train_r2', 'train_rmse', 'train_mae', 'train_cv', 'test_r2', 'test_mape'))},
       {s6('train_r2 - test_r2', 'overfitting_gap')}, 2 AS feature_count, '24' AS lookback
FROM wide""")
def b04(spark, folder):
    documents = _documents(spark, folder)
    path = reports.write_json(documents, scratch_path(spark, "metrics"))
    read = spark.read.schema(documents.schema).json(path)
    return read.select(
        "model", *[r6(f"train_metrics.{m}", f"train_{m.lower()}") for m in ("R2", "RMSE", "MAE", "CV")],
        r6("test_metrics.R2", "test_r2"), r6("test_metrics.MAPE", "test_mape"), r6("overfitting_gap"),
        "feature_count", F.col("config")["lookback"].alias("lookback"))


_FIVE = ("R2", "RMSE", "MAE", "CV", "MAPE")


@query("b05_metrics_summary", predictions_sql() + metrics_sql() + f"""
SELECT model, CASE split WHEN 'train' THEN 'Training' ELSE 'Testing' END AS "Set", 'by date' AS "Split_Method",
       {', '.join(s6(c) for c in _FIVE)} FROM scores""")
def b05(spark, folder):
    summary = reports.metrics_summary(metrics.evaluate(predictions(spark, folder)), split_method="by date")
    return summary.select("model", "Set", "Split_Method", *[r6(c) for c in _FIVE])


@query("b07_predictions_long", predictions_sql() + """
SELECT model, split, series, ts, actual, predicted FROM pred""")
def b07(spark, folder):
    long = tables.long_predictions(predictions(spark, folder), HOURLY, "actual", "predicted", ["model", "split"])
    path = scratch_path(spark, "predictions")
    long.write.parquet(path)
    return spark.read.schema(long.schema).parquet(path)


@query("b08_predictions_wide", predictions_sql() + """,
n AS (SELECT model, series, split, actual, predicted,
             row_number() OVER (PARTITION BY model, series, split ORDER BY ts) AS row_number FROM pred)
SELECT model, series, row_number,
       max(CASE WHEN split = 'train' THEN actual END) AS actual_train, max(CASE WHEN split = 'train' THEN predicted END) AS predicted_train,
       max(CASE WHEN split = 'train' THEN actual - predicted END) AS residuals_train,
       max(CASE WHEN split = 'test' THEN actual END) AS actual_test, max(CASE WHEN split = 'test' THEN predicted END) AS predicted_test,
       max(CASE WHEN split = 'test' THEN actual - predicted END) AS residuals_test
FROM n GROUP BY model, series, row_number""")
def b08(spark, folder):
    by_model = HOURLY.at(series=("model", *HOURLY.series))
    return tables.wide_predictions(predictions(spark, folder), by_model, "actual", "predicted")


@query("b10_scaler_state", hourly_sql() + f""",
f AS (SELECT *, {SPLIT_SQL} AS split FROM hourly)
""" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, {s6(f'avg({c})', 'mean')}, {s6(f'stddev_pop({c})', 'scale')} FROM f WHERE split = 'train'"
    for c in ("temperature", "humidity", "demand")))
def b10(spark, folder):
    train = split_at_date(hourly_events(spark, folder), "date", SPLIT_DATE).where("split = 'train'")
    stats = scaling.fit_scaler(train, ["temperature", "humidity", "demand"])
    path = tables.write_scaler(stats, scratch_path(spark, "scaler"))
    return results.read_scaler(spark, path).select("feature", r6("mean"), r6("scale"))
