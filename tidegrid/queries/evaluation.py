"""Metrics, residuals, comparisons, ranks, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.models.combine import choose, row_mean
from tidegrid.operators import metrics, residuals
from tidegrid.operators.rolling import demand_lags
from tidegrid.operators.splitting import split_at_date, split_tail
from tidegrid.queries.base import (
    HOURLY, METRIC_SQL, SPLIT_DATE, hourly_events, hourly_sql, lag_sql, metrics_sql, predictions, predictions_sql,
    query, r6, s6,
)
from tidegrid.timeline import over_past

BY = ["model", "split"]
_Y = ("actual", "predicted")


def _metric(name: str, column, digits: int = 6):
    return F.round(column, digits).alias(name)


def _scores(spark, folder):
    return metrics.evaluate(predictions(spark, folder))


@query("h01_r2", predictions_sql() + f"\nSELECT model, split, {s6(METRIC_SQL['R2'], 'R2')} FROM pred GROUP BY model, split")
def h01(spark, folder):
    return predictions(spark, folder).groupBy(*BY).agg(_metric("R2", metrics.r2(*_Y)))


@query("h02_rmse_mae", predictions_sql() + f"""
SELECT model, split, {s6(METRIC_SQL['RMSE'], 'RMSE')}, {s6(METRIC_SQL['MAE'], 'MAE')} FROM pred GROUP BY model, split""")
def h02(spark, folder):
    return predictions(spark, folder).groupBy(*BY).agg(
        _metric("RMSE", metrics.rmse(*_Y)), _metric("MAE", metrics.mae(*_Y)))


@query("h03_cv", predictions_sql() + f"\nSELECT model, split, {s6(METRIC_SQL['CV'], 'CV')} FROM pred GROUP BY model, split")
def h03(spark, folder):
    return predictions(spark, folder).groupBy(*BY).agg(_metric("CV", metrics.cv_percent(*_Y)))


@query("h04_mape_skip_zero", predictions_sql() + f"""
SELECT model, split, {s6(METRIC_SQL['MAPE'], 'MAPE')} FROM pred GROUP BY model, split""")
def h04(spark, folder):
    return predictions(spark, folder).groupBy(*BY).agg(_metric("MAPE", metrics.mape(*_Y)))


@query("h05_mape_floor", predictions_sql("event_type") + f"""
SELECT model, split, {s6("avg(CASE WHEN actual > 4 THEN abs(actual - predicted) / CAST(actual AS DOUBLE) * 100 END)", 'MAPE')}
FROM pred GROUP BY model, split""")
def h05(spark, folder):
    rows = predictions(spark, folder, "event_type")
    return rows.groupBy(*BY).agg(_metric("MAPE", metrics.mape(*_Y, mode="floor", min_actual=4)))


@query("h06_mape_epsilon", predictions_sql("event_type") + """
SELECT model, split, round(avg(abs((actual - predicted) / (actual + 1e-8)) * 100), 2) AS MAPE
FROM pred GROUP BY model, split""")
def h06(spark, folder):
    rows = predictions(spark, folder, "event_type")
    return rows.groupBy(*BY).agg(_metric("MAPE", metrics.mape(*_Y, mode="epsilon"), 2))


@query("h07_mape_raw", predictions_sql("event_type") + f"""
SELECT model, series, date, {s6("CASE WHEN count(*) FILTER (actual = 0) = 0 THEN avg(abs(actual - predicted) / CAST(nullif(actual, 0) AS DOUBLE) * 100) END", 'MAPE')}
FROM pred GROUP BY model, series, date""")
def h07(spark, folder):
    rows = predictions(spark, folder, "event_type")
    return rows.groupBy("model", "series", "date").agg(_metric("MAPE", metrics.mape(*_Y, mode="raw")))


@query("h08_residual", predictions_sql() + """
SELECT series, ts, model, actual - predicted AS residual, predicted - actual AS error FROM pred""")
def h08(spark, folder):
    return predictions(spark, folder).select(
        "series", "ts", "model",
        metrics.residual(*_Y).alias("residual"),
        metrics.residual(*_Y, sign="predicted_minus_actual").alias("error"))


_GAP_SQL = predictions_sql() + metrics_sql() + """,
gaps AS (SELECT model, max(CASE WHEN split = 'train' THEN R2 END) AS train_r2,
                max(CASE WHEN split = 'test' THEN R2 END) AS test_r2 FROM scores GROUP BY model),
g AS (SELECT *, train_r2 - test_r2 AS gap FROM gaps)"""


@query("h09_overfitting_gap", _GAP_SQL + f"\nSELECT model, {s6('train_r2')}, {s6('test_r2')}, {s6('gap')} FROM g")
def h09(spark, folder):
    return metrics.split_gap(_scores(spark, folder)).select("model", r6("train_r2"), r6("test_r2"), r6("gap"))


@query("h10_gap_verdict", predictions_sql() + metrics_sql("series, model, split") + """,
gaps AS (SELECT series, model, max(CASE WHEN split = 'train' THEN R2 END) - max(CASE WHEN split = 'test' THEN R2 END) AS gap
         FROM scores GROUP BY series, model)
SELECT series, model, round(gap, 6) + 0.0 AS gap,
  CASE WHEN gap < 0.05 THEN 'excellent' WHEN gap < 0.08 THEN 'good' WHEN gap < 0.10 THEN 'acceptable'
       WHEN gap IS NOT NULL THEN 'needs regularization' END AS verdict,
  CASE WHEN gap < 0.10 THEN 'good' WHEN gap < 0.15 THEN 'moderate overfitting'
       WHEN gap IS NOT NULL THEN 'significant overfitting' END AS coarse_verdict
FROM gaps""")
def h10(spark, folder):
    scored = metrics.evaluate(predictions(spark, folder), by=["series", "model", "split"])
    gaps = metrics.split_gap(scored, ["series", "model"])
    return gaps.select("series", "model", r6("gap"), metrics.gap_verdict(F.col("gap")).alias("verdict"),
                       metrics.gap_verdict(F.col("gap"), "three").alias("coarse_verdict"))


def _improvement_sql(score: str, target: float, sign: int) -> str:
    return predictions_sql("event_type") + metrics_sql() + f""",
t AS (SELECT model, {score}, (SELECT {score} FROM scores WHERE model = 'persistence' AND split = 'test') AS baseline
      FROM scores WHERE split = 'test')
SELECT model, {s6(score)}, {s6('baseline')}, {s6(f'{sign} * ({score} - baseline) * 100 / nullif(baseline, 0)', 'relative_percent')},
       {s6(f'{sign} * ({score} - baseline) * 100', 'points')},
       CAST({sign} * ({target} - {score}) <= 0 AS INTEGER) AS target_reached,
       {s6(f'greatest({sign} * ({target} - {score}) * 100, 0.0)', 'target_gap')}
FROM t"""


def _improvement(spark, folder, score, target, lower_is_better=False):
    test = metrics.evaluate(predictions(spark, folder, "event_type")).where("split = 'test'")
    baseline = test.where("model = 'persistence'").agg(F.max(score)).scalar()
    compared = metrics.improvement(test.select("model", score), score, baseline, target, lower_is_better)
    return compared.select("model", *[r6(c) for c in (score, "baseline", "relative_percent", "points")],
                           "target_reached", r6("target_gap"))


@query("h11_improvement", _improvement_sql("R2", metrics.TARGET_R2, 1))
def h11(spark, folder):
    return _improvement(spark, folder, "R2", metrics.TARGET_R2)


@query("h11_improvement_of_errors", _improvement_sql("RMSE", 5.0, -1))
def h11_of_errors(spark, folder):
    return _improvement(spark, folder, "RMSE", 5.0, lower_is_better=True)


@query("h12_leaderboard", _GAP_SQL + f"""
SELECT model, {s6('test_r2')}, rank() OVER (ORDER BY test_r2 DESC) AS "rank" FROM g""")
def h12(spark, folder):
    ranked = metrics.rank_models(metrics.split_gap(_scores(spark, folder)))
    return ranked.select("model", r6("test_r2"), F.col("rank").cast("bigint").alias("rank"))


@query("h12_leaderboard_by_series", predictions_sql() + metrics_sql("series, model, split") + f"""
SELECT series, model, {s6('RMSE')}, rank() OVER (PARTITION BY series ORDER BY round(RMSE, 6)) AS "rank"
FROM scores WHERE split = 'test'""")
def h12_series(spark, folder):
    scored = metrics.evaluate(predictions(spark, folder), by=["series", "model", "split"]).where("split = 'test'")
    ranked = metrics.rank_models(scored.withColumn("_score", -r6("RMSE", "RMSE")), ["series"], "_score")
    return ranked.select("series", "model", r6("RMSE"), F.col("rank").cast("bigint").alias("rank"))


def _figures_sql(figures: dict[str, float]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT model, '{m}' AS metric, {m} AS measured, CAST({v} AS DOUBLE) AS reference FROM t"
        for m, v in figures.items())


@query("h13_paper_comparison", predictions_sql() + metrics_sql() + f""",
t AS (SELECT * FROM scores WHERE split = 'test'),
c AS ({_figures_sql(metrics.PAPER_FIGURES)})
SELECT model, metric, {s6('measured')}, reference, {s6('measured - reference', 'difference')} FROM c""")
def h13(spark, folder):
    compared = metrics.compare_with(_scores(spark, folder).where("split = 'test'"), metrics.PAPER_FIGURES)
    return compared.select("model", "metric", r6("measured"), "reference", r6("difference"))


@query("k02_union_rows", predictions_sql() + """
SELECT series, ts, split, model, actual, predicted FROM pred""")
def k02(spark, folder):
    raw = hourly_events(spark, folder).select("series", "ts", "date", "demand")
    lagged = split_at_date(over_past(raw, HOURLY, 168, demand_lags), "date", SPLIT_DATE)

    def one(model: str, lag: int):
        return lagged.select(
            "series", "ts", "split", F.lit(model).alias("model"), F.col("demand").alias("actual"),
            F.col(f"demand_lag_{lag}h").alias("predicted")).where(F.col("predicted").isNotNull())

    return one("persistence", 1).unionByName(one("seasonal", 24))


_ERRORS_SQL = predictions_sql("event_type") + ",\ne AS (SELECT model, predicted - actual AS error FROM pred)"


@query("g17_residual_histogram", _ERRORS_SQL + f""",
reach AS (SELECT model, min(error) AS lo, max(error) AS hi FROM e GROUP BY model),
b AS (SELECT e.model, lo, hi, CAST(least(floor((error - lo) * 50 / CAST(hi - lo AS DOUBLE)) + 1, 50) AS INTEGER) AS bin
      FROM e JOIN reach ON e.model = reach.model)
SELECT model, bin, {s6('lo + (hi - lo) / 50.0e0 * (bin - 1)', 'bin_from')}, {s6('lo + (hi - lo) / 50.0e0 * bin', 'bin_to')},
       count(*) AS frequency
FROM b GROUP BY model, lo, hi, bin""")
def g17(spark, folder):
    rows = predictions(spark, folder, "event_type").select(
        "model", metrics.residual(*_Y, sign="predicted_minus_actual").alias("error"))
    bins = residuals.residual_histogram(rows, "error", 50, ["model"])
    return bins.select("model", "bin", r6("bin_from"), r6("bin_to"), "frequency")


@query("g18_residual_moments", _ERRORS_SQL + f"""
SELECT model, {s6('avg(error)', 'mean_residual')}, {s6('stddev_pop(error)', 'std_residual')} FROM e GROUP BY model""")
def g18(spark, folder):
    rows = predictions(spark, folder, "event_type").select(
        "model", metrics.residual(*_Y, sign="predicted_minus_actual").alias("error"))
    return residuals.residual_moments(rows, "error", ["model"]).select(
        "model", r6("mean_residual"), r6("std_residual"))


@query("i05_ensemble_mean", hourly_sql() + f""",
p AS (SELECT series, ts, demand, {lag_sql('demand', 1)} AS a, {lag_sql('demand', 24)} AS b, {lag_sql('demand', 168)} AS c FROM hourly)
SELECT series, ts, demand, {s6('(a + b + c) / 3.0e0', 'predicted')} FROM p WHERE c IS NOT NULL""")
def i05(spark, folder):
    raw = hourly_events(spark, folder).select("series", "ts", "demand")
    lagged = over_past(raw, HOURLY, 168, demand_lags).where(F.col("demand_lag_168h").isNotNull())
    names = ["demand_lag_1h", "demand_lag_24h", "demand_lag_168h"]
    return row_mean(lagged, names).select("series", "ts", "demand", r6("predicted"))


@query("i10_candidate_choice", predictions_sql() + """,
n AS (SELECT *, row_number() OVER (PARTITION BY series, model ORDER BY ts) AS rn,
             count(*) OVER (PARTITION BY series, model) AS n FROM pred WHERE split = 'train'),
v AS (SELECT series, model, sqrt(avg((actual - predicted) * (actual - predicted))) AS RMSE FROM n
      WHERE rn > n - CAST(floor(0.2 * n) AS BIGINT) GROUP BY series, model),
r AS (SELECT series, model, round(RMSE, 6) + 0.0 AS RMSE FROM v)
SELECT series, model, RMSE FROM (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY RMSE, model) AS k FROM r) WHERE k = 1""")
def i10(spark, folder):
    train = predictions(spark, folder).where("split = 'train'")
    validation = split_tail(train, HOURLY, 0.2, ["model"]).where("role = 'validation'")
    scored = validation.groupBy("series", "model").agg(_metric("RMSE", metrics.rmse(*_Y)))
    return choose(scored, ["series"])
