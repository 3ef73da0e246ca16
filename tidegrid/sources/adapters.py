"""Given tables to the raw hourly or daily schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.operators.grid import fill_grid
from tidegrid.timeline import Timeline

DAY = 86400
# the tables below have every cell of every series
HOURLY = Timeline(series=("series",), time="ts", step=3600, complete=True)
DAILY = Timeline(series=("series",), time="ts", step=DAY, complete=True)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def hourly_events(
    spark: SparkSession,
    folder: str,
    series: str = "user_id",
    since: str | None = None,
    until: str | None = None,
) -> DataFrame:
    """Hourly activity per ``series`` in the shape of the raw table.

    Columns: series, ts, date, hour, demand, the eight measurements, season,
    holiday, functioning. The mapping only serves to exercise every feature.
    """
    # columns a caller drops are pruned up to the scan, so only what is used is read
    events = read_table(spark, folder, "events").selectExpr(
        f"`{series}` AS series",
        "ts",
        "1 AS seen",
        "CAST(value AS DECIMAL(18,2)) AS v",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
    )
    cells = fill_grid(events, HOURLY, {
        "demand": "count(seen)",
        "temperature": "coalesce(try_divide(CAST(sum(v) AS DOUBLE), count(seen)), 0.0D)",
        "humidity": "coalesce(try_divide(CAST(sum(k) AS DOUBLE), count(seen)), 50.0D)",
        "wind_speed": "coalesce(CAST(max(v) - min(v) AS DOUBLE), 0.0D)",
        "visibility": "coalesce(CAST(sum(v) * 10 AS DOUBLE), 2000.0D)",
        "solar": "coalesce(CAST(min(v) AS DOUBLE), 0.0D)",
        "rainfall": "CAST(count_if(k >= 90) AS DOUBLE)",
        "snowfall": "CAST(count_if(k <= 3) AS DOUBLE)",
    }, since=since, until=until)
    return cells.selectExpr(
        "series", "ts", "CAST(ts AS DATE) AS date", "hour(ts) AS hour",
        "demand", "temperature", "humidity", "wind_speed", "visibility",
        "temperature - (100 - humidity) / 5 AS dew_point",
        "solar", "rainfall", "snowfall",
        "CASE WHEN day(ts) <= 7 THEN 'Winter' WHEN day(ts) <= 14 THEN 'Spring' "
        "WHEN day(ts) <= 21 THEN 'Summer' ELSE 'Autumn' END AS season",
        "IF(day(ts) IN (1, 15), 'Holiday', 'No Holiday') AS holiday",
        "IF(hour(ts) = 3, 'No', 'Yes') AS functioning",
    )


def daily_orders(spark: SparkSession, folder: str, series: str = "o_orderpriority") -> DataFrame:
    """Daily orders per ``series``: series, ts, date, demand, temperature (mean price)."""
    orders = read_table(spark, folder, "orders").selectExpr(
        f"`{series}` AS series", "o_orderdate AS ts", "1 AS seen", "CAST(o_totalprice AS DECIMAL(18,2)) AS v")
    cells = fill_grid(orders, DAILY, {
        "demand": "count(seen)",
        "temperature": "coalesce(try_divide(CAST(sum(v) AS DOUBLE), count(seen)), 0.0D)",
    })
    return cells.selectExpr("series", "ts", "CAST(ts AS DATE) AS date", "demand", "temperature")
