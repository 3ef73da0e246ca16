"""Accuracy metrics, gaps, comparisons and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the verdict bands and comparison figures.
GAP_BANDS = {
    "four": [(0.05, "excellent"), (0.08, "good"), (0.10, "acceptable"), (None, "needs regularization")],
    "three": [(0.10, "good"), (0.15, "moderate overfitting"), (None, "significant overfitting")],
}
PAPER_FIGURES = {"R2": 0.9500, "RMSE": 139.64, "MAE": 78.45, "CV": 19.81}
PUBLISHED_FIGURES = {"R2": 0.9394835002604611, "RMSE": 158.16657206828776, "MAE": 87.66043652786654,
                     "CV": 22.394020535357996}
BASELINE_R2 = 0.5471
TARGET_R2 = 0.8837
MIN_ACTUAL = 10
EPSILON = 1e-8
SPLIT_LABELS = {"train": "Training", "test": "Testing"}


def _doubles(actual: str, predicted: str) -> tuple[Column, Column]:
    """Both sides as double, both NULL unless both are known."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    known = y.isNotNull() & p.isNotNull()
    return F.when(known, y), F.when(known, p)


def r2(actual: str, predicted: str) -> Column:
    """NULL for constant actuals."""
    y, p = _doubles(actual, predicted)
    return 1 - F.try_divide(F.sum((y - p) * (y - p)), F.count(y) * F.var_pop(y))


def rmse(actual: str, predicted: str) -> Column:
    y, p = _doubles(actual, predicted)
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(actual: str, predicted: str) -> Column:
    y, p = _doubles(actual, predicted)
    return F.avg(F.abs(y - p))


def cv_percent(actual: str, predicted: str) -> Column:
    y, _ = _doubles(actual, predicted)
    return F.try_divide(rmse(actual, predicted) * 100, F.avg(y))


def mape(actual: str, predicted: str, mode: str = "skip_zero", min_actual: float = MIN_ACTUAL,
         eps: float = EPSILON) -> Column:
    """Percent error in one of four readings; NULL where it is undefined.

    ``skip_zero`` leaves out zero actuals, ``floor`` keeps actuals above
    ``min_actual``, ``epsilon`` adds ``eps`` to the actual, ``raw`` masks nothing
    and so is NULL as soon as one actual is zero.
    """
    y, p = _doubles(actual, predicted)
    relative = F.abs(F.try_divide(y - p, y)) * 100
    if mode == "skip_zero":
        return F.avg(F.when(y != 0, relative))
    if mode == "floor":
        return F.avg(F.when(y > min_actual, relative))
    if mode == "epsilon":
        return F.avg(F.abs(F.try_divide(y - p, y + F.lit(eps))) * 100)
    if mode == "raw":
        return F.when(F.count_if(y == 0) == 0, F.avg(relative))
    raise ValueError("mode must be skip_zero, floor, epsilon or raw")


def evaluate(
    df: DataFrame,
    actual: str = "actual",
    predicted: str = "predicted",
    by: Sequence[str] = ("model", "split"),
    mape_mode: str = "skip_zero",
    min_actual: float = MIN_ACTUAL,
) -> DataFrame:
    """``R2, RMSE, MAE, CV, MAPE`` per group, on unscaled actuals."""
    return df.groupBy(*by).agg(
        r2(actual, predicted).alias("R2"),
        rmse(actual, predicted).alias("RMSE"),
        mae(actual, predicted).alias("MAE"),
        cv_percent(actual, predicted).alias("CV"),
        mape(actual, predicted, mape_mode, min_actual).alias("MAPE"),
    )


def residual(actual: str, predicted: str, sign: str = "actual_minus_predicted") -> Column:
    y, p = F.col(actual), F.col(predicted)
    if sign == "actual_minus_predicted":
        return y - p
    if sign == "predicted_minus_actual":
        return p - y
    raise ValueError("sign must be actual_minus_predicted or predicted_minus_actual")


def split_gap(metrics: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Train R2, test R2 and their difference."""

    def of(split: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col("R2")))

    wide = metrics.groupBy(*by).agg(of("train").alias("train_r2"), of("test").alias("test_r2"))
    return wide.withColumn("gap", F.col("train_r2") - F.col("test_r2"))


def gap_verdict(gap: Column, bands: str = "four") -> Column:
    """The first band whose upper bound the gap stays below."""
    verdict = None
    for bound, label in GAP_BANDS[bands]:
        if bound is None:
            verdict = verdict.otherwise(label)
        elif verdict is None:
            verdict = F.when(gap < bound, label)
        else:
            verdict = verdict.when(gap < bound, label)
    return F.when(gap.isNotNull(), verdict)


def improvement(
    df: DataFrame, score: str, baseline: Column, target: float = TARGET_R2, lower_is_better: bool = False
) -> DataFrame:
    """Relative percent and points over a baseline; whether and by how much the target is missed.

    ``lower_is_better`` is for errors: what a score lies below the baseline or the
    target counts as better.
    """
    sign = -1.0 if lower_is_better else 1.0
    points = (F.col(score) - F.col("baseline")) * (100 * sign)
    missing = (F.lit(target) - F.col(score)) * sign
    return df.withColumn("baseline", baseline).withColumns({
        "relative_percent": F.try_divide(points, F.col("baseline")),
        "points": points,
        "target_reached": (missing <= 0).cast("int"),
        "target_gap": F.greatest(missing * 100, F.lit(0.0)),
    })


def rank_models(metrics: DataFrame, by: Sequence[str] = (), score: str = "test_r2") -> DataFrame:
    """Rank per ``by`` on a score, best first. One input row per model."""
    window = Window.partitionBy(*by).orderBy(F.desc_nulls_last(score))
    return metrics.withColumn("rank", F.rank().over(window))


def compare_with(metrics: DataFrame, figures: dict[str, float], by: Sequence[str] = ("model",)) -> DataFrame:
    """One row per metric: measured, reference figure and difference."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("measured"), F.lit(float(v)).alias("reference"))
        for m, v in figures.items()
    ])).alias("_row")
    return metrics.select(*by, rows).select(*by, "_row.*").withColumn(
        "difference", F.col("measured") - F.col("reference")
    )


def persistence(df: DataFrame, season: int = 1) -> Column:
    """Helper predictor: the value ``season`` rows earlier, from the lag column."""
    return F.col(f"demand_lag_{season}h").cast("double")
