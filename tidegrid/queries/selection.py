"""Sort, projection, split and limit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.columns import FEATURE_SETS, FEATURES
from tidegrid.functions.hashing import arithmetic_hash
from tidegrid.operators import selecting, splitting
from tidegrid.operators.correlation import correlation_with
from tidegrid.operators.numbering import number_in_series
from tidegrid.plans.features import feature_table, model_table
from tidegrid.queries.base import (
    DAILY, DAILY_SQL, HOURLY, SPLIT_DATE, SPLIT_SQL, WINDOW_SQL, daily_orders, features_sql, hourly_events,
    hourly_sql, query, r6, s6, shown, shown_sql,
)
from tidegrid.timeline import over_past
from tidegrid.operators.rolling import window_features

KEYS = ["series", "ts"]


@query("c01_chronological", hourly_sql() + """
SELECT series, ts, demand, row_number() OVER (PARTITION BY series ORDER BY ts) AS position FROM hourly""")
def c01(spark, folder):
    raw = hourly_events(spark, folder).select(*KEYS, "demand")
    return selecting.chronological(number_in_series(raw, HOURLY), HOURLY)


@query("c02_target_copy", hourly_sql() + """
SELECT series, ts, demand, demand AS target FROM hourly""")
def c02(spark, folder):
    return selecting.copy_target(hourly_events(spark, folder)).select(*KEYS, "demand", "target")


@query("c03_drop_originals", hourly_sql() + """
SELECT series, ts, demand, round(temperature, 6) AS temperature, round(humidity, 6) AS humidity,
       wind_speed, visibility, round(dew_point, 6) + 0.0 AS dew_point, solar, rainfall, snowfall
FROM hourly""")
def c03(spark, folder):
    dropped = selecting.drop_originals(hourly_events(spark, folder))
    return dropped.withColumns({c: r6(c) for c in ("temperature", "humidity", "dew_point")})


def _set_query(size: int):
    names = FEATURE_SETS[size]

    @query(f"c04_feature_set_{size}", hourly_sql() + features_sql() + f"""
SELECT series, ts, {shown_sql(names)} FROM feat""")
    def run(spark, folder):
        chosen = selecting.feature_set(feature_table(hourly_events(spark, folder), HOURLY), size, KEYS)
        return chosen.select(*KEYS, *shown(names))

    return run


for _size in FEATURE_SETS:
    _set_query(_size)


@query("c05_complement", hourly_sql() + features_sql() + f"""
SELECT target, {shown_sql(FEATURES)} FROM feat WHERE demand_lag_168h IS NOT NULL""")
def c05(spark, folder):
    table = model_table(hourly_events(spark, folder), HOURLY, SPLIT_DATE)
    chosen = selecting.complement(table, ["series", "ts", "split"])
    return chosen.select("target", *shown([c for c in chosen.columns if c != "target"]))


@query("c07_date_split", hourly_sql() + f"""
SELECT series, ts, demand, {SPLIT_SQL} AS split FROM hourly""")
def c07(spark, folder):
    return splitting.split_at_date(hourly_events(spark, folder), "date", SPLIT_DATE).select(*KEYS, "demand", "split")


@query("c08_months_split", DAILY_SQL + """
SELECT series, ts, demand,
       CASE WHEN date < CAST((SELECT min(date) FROM daily) + INTERVAL 9 MONTH AS DATE) THEN 'train' ELSE 'test' END AS split
FROM daily""")
def c08(spark, folder):
    return splitting.split_after_months(daily_orders(spark, folder), "date", 9).select(*KEYS, "demand", "split")


_KEY_SQL = "(date_diff('day', DATE '1970-01-01', date) * 10 + CAST(substr(series, 1, 1) AS BIGINT))"


@query("c09_stratified_split", DAILY_SQL + f""",
b AS (SELECT quantile_cont(temperature, 0.0) AS b0, quantile_cont(temperature, 0.25) AS b1,
             quantile_cont(temperature, 0.5) AS b2, quantile_cont(temperature, 0.75) AS b3,
             quantile_cont(temperature, 1.0) AS b4 FROM daily),
s AS (SELECT series, ts, temperature,
        CAST(b1 > b0 AND b1 < b4 AND temperature > b1 AS INTEGER)
      + CAST(b2 > b1 AND b2 < b4 AND temperature > b2 AS INTEGER)
      + CAST(b3 > b2 AND b3 < b4 AND temperature > b3 AS INTEGER) AS bin,
        (({_KEY_SQL} % 2147483647) * 2654435761) % 2147483647 AS h
      FROM daily CROSS JOIN b),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY h, series, ts) AS rn, count(*) OVER (PARTITION BY bin) AS n FROM s)
SELECT series, ts, round(temperature, 4) AS temperature, CASE WHEN rn <= ceil(0.75 * n) THEN 'train' ELSE 'test' END AS split
FROM r""")
def c09(spark, folder):
    key = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long") * 10 + F.substring("series", 1, 1).cast("long")
    split = splitting.split_stratified(
        daily_orders(spark, folder), "temperature", KEYS, hashed=arithmetic_hash(key), bits=31)
    return split.select(*KEYS, F.round("temperature", 4).alias("temperature"), "split")


@query("c10_tail_validation", hourly_sql() + """,
n AS (SELECT series, ts, row_number() OVER (PARTITION BY series ORDER BY ts) AS rn,
             count(*) OVER (PARTITION BY series) AS n FROM hourly)
SELECT series, ts, CASE WHEN rn > n - CAST(floor(0.2 * n) AS BIGINT) THEN 'validation' ELSE 'train' END AS role FROM n""")
def c10(spark, folder):
    return splitting.split_tail(hourly_events(spark, folder).select(*KEYS), HOURLY, 0.2)


@query("c11_complete_cases", hourly_sql() + f""",
f AS (SELECT series, ts, demand, {WINDOW_SQL['demand_lag_168h']} AS demand_lag_168h,
             {WINDOW_SQL['demand_rolling_24h_std']} AS demand_rolling_24h_std FROM hourly)
SELECT series, ts, demand, demand_lag_168h, {s6('demand_rolling_24h_std')}
FROM f WHERE demand_lag_168h IS NOT NULL AND demand_rolling_24h_std IS NOT NULL""")
def c11(spark, folder):
    built = over_past(hourly_events(spark, folder), HOURLY, 168, window_features)
    return selecting.complete_cases(built, ["demand_lag_168h", "demand_rolling_24h_std"]).select(
        *KEYS, "demand", "demand_lag_168h", r6("demand_rolling_24h_std"))


@query("c12_head", hourly_sql() + """
SELECT series, ts, demand FROM hourly ORDER BY ts, series LIMIT 200""")
def c12(spark, folder):
    return selecting.head(hourly_events(spark, folder).select(*KEYS, "demand"), HOURLY, 200)


_RANKED = [
    "temperature", "humidity", "wind_speed", "visibility", "dew_point", "solar", "rainfall", "snowfall",
    "demand_lag_1h", "demand_lag_2h", "demand_lag_3h", "demand_lag_24h", "demand_lag_168h",
    "demand_rolling_3h_mean", "demand_rolling_6h_mean", "demand_rolling_12h_mean", "demand_rolling_24h_mean",
    "temp_squared", "apparent_temp", "wind_chill",
]


@query("c13_top_k", hourly_sql() + features_sql() + ",\nscored AS (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr({c}, target)) AS score FROM feat" for c in _RANKED
) + f")\nSELECT feature, {s6('score')} FROM scored ORDER BY scored.score DESC, feature LIMIT 15")
def c13(spark, folder):
    table = feature_table(hourly_events(spark, folder), HOURLY)
    pairs = correlation_with(table, _RANKED, "target")
    best = selecting.top(pairs.select(F.col("left").alias("feature"), F.col("correlation").alias("score")), "score", 15, ["feature"])
    return best.select("feature", r6("score"))


@query("daily_positions_with_gaps", """
WITH d AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS TIMESTAMP) AS ts, count(*) AS demand
           FROM orders GROUP BY 1, 2)
SELECT series, ts, demand, row_number() OVER (PARTITION BY series ORDER BY ts) AS position,
       lag(demand, 3) OVER (PARTITION BY series ORDER BY ts) AS demand_three_rows_back FROM d""")
def positions(spark, folder):
    from tidegrid.sources.adapters import read_table

    days = read_table(spark, folder, "orders").groupBy(
        F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts")
    ).agg(F.count(F.lit(1)).alias("demand"))
    timeline = DAILY.at(block=100)
    numbered = number_in_series(days, timeline)
    return over_past(numbered, timeline.at(position="position"), 3, lambda w: {
        "demand_three_rows_back": F.lag("demand", 3).over(w)})
