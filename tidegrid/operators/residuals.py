"""Residual summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def residual_histogram(df: DataFrame, value: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins from the minimum to the maximum; the last bin is closed.

    The range of each group is one small aggregate. If all values are equal the
    range is widened by a half on either side. Empty bins are absent.
    """
    keys = list(by)
    limits = df.groupBy(*keys).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    pad = "IF(lo = hi, 0.5D, 0.0D)"
    span = limits.selectExpr(*keys, f"lo - {pad} AS lo", f"hi + {pad} AS hi")
    if keys:
        ranged = df.select(*keys, F.col(value).alias("_v")).join(span, keys)
    else:
        both = span.select(F.struct("lo", "hi")).scalar()
        ranged = df.select(F.col(value).alias("_v"), both.alias("_s")).select("_v", "_s.lo", "_s.hi")
    place = f"least(floor((_v - lo) * {bins} / (hi - lo)) + 1, {bins})"
    placed = ranged.where("_v IS NOT NULL").withColumn("bin", F.expr(place).cast("int"))
    counts = placed.groupBy(*keys, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("frequency"))
    width = (F.col("hi") - F.col("lo")) / bins
    return counts.select(
        *keys, "bin",
        (F.col("lo") + width * (F.col("bin") - 1)).alias("bin_from"),
        (F.col("lo") + width * F.col("bin")).alias("bin_to"),
        "frequency",
    )


def residual_moments(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean_residual"), F.stddev_pop(value).alias("std_residual"))
