"""Lookback windows, point features and causal filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidegrid.timeline import Timeline, over_past


def lookback(
    df: DataFrame,
    timeline: Timeline,
    features: Sequence[str],
    length: int = 24,
    within: Sequence[str] = ("split",),
    name: str = "sequence",
) -> DataFrame:
    """The feature rows of the ``length`` steps before each row, oldest first.

    Rows without that many predecessors in their series and split are dropped, so
    every split loses its first ``length`` rows. The features of the row itself
    are not in its sequence. A NULL feature stays a NULL element.
    """
    row = F.array(*[F.col(f).cast("double") for f in features])

    def build(window: WindowSpec) -> dict[str, Column]:
        return {name: F.collect_list(row).over(window.rowsBetween(-length, -1))}

    return over_past(df, timeline, length, build, within).where(F.size(name) == length)


def point_features(
    df: DataFrame,
    timeline: Timeline,
    features: Sequence[str],
    length: int = 24,
    within: Sequence[str] = ("split",),
    name: str = "point",
) -> DataFrame:
    """The last row of each lookback window as a struct, without building the window."""

    def build(window: WindowSpec) -> dict[str, Column]:
        return {
            name: F.lag(F.struct(*features), 1).over(window),
            "_seen": F.count(F.lit(1)).over(window.rowsBetween(-length, -1)),
        }

    return over_past(df, timeline, length, build, within).where(F.col("_seen") == length).drop("_seen")


def causal_filter(window: WindowSpec, value: str | Column, weights: Sequence[float], dilation: int = 1) -> Column:
    """Weighted sum of a row and earlier rows ``dilation`` apart.

    ``weights`` run from the oldest input to the current row; inputs before the
    start of the series count as zero.
    """
    value = F.col(value) if isinstance(value, str) else value
    total = None
    for steps_back, weight in enumerate(reversed(list(weights))):
        shifted = value if steps_back == 0 else F.lag(value, steps_back * dilation).over(window)
        term = F.lit(float(weight)) * F.coalesce(shifted, F.lit(0.0))
        total = term if total is None else total + term
    return total


def filter_bank(
    df: DataFrame,
    timeline: Timeline,
    value: str,
    kernels: dict[int, Sequence[float]],
    dilation: int = 1,
    within: Sequence[str] = (),
) -> DataFrame:
    """One causal filter per kernel size, as columns ``scale_<size>``."""
    for size, weights in kernels.items():
        if len(weights) != size:
            raise ValueError(f"kernel {size} has {len(weights)} weights")
    reach = max((size - 1) * dilation for size in kernels)

    def build(window: WindowSpec) -> dict[str, Column]:
        return {f"scale_{size}": causal_filter(window, value, w, dilation) for size, w in kernels.items()}

    return over_past(df, timeline, reach, build, within)


def stacked_filter(
    df: DataFrame,
    timeline: Timeline,
    value: str,
    levels: Sequence[Sequence[float]],
    name: str = "filtered",
    within: Sequence[str] = (),
) -> DataFrame:
    """Filters applied one after another, level ``i`` with dilation ``2**i``."""
    out = df.withColumn(name, F.col(value).cast("double"))
    for level, weights in enumerate(levels):
        dilation = 2**level

        def build(window: WindowSpec, weights=weights, dilation=dilation) -> dict[str, Column]:
            return {name: causal_filter(window, name, weights, dilation)}

        out = over_past(out, timeline, (len(weights) - 1) * dilation, build, within)
    return out


def receptive_field(kernel: int, levels: int, per_level: int = 1) -> int:
    """Rows a stack of filters sees, with ``per_level`` filters at each dilation."""
    return 1 + sum(per_level * (kernel - 1) * 2**level for level in range(levels))


def scale_share(df: DataFrame, kernels: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute output of each filter and its share of the total."""
    sizes = [f"scale_{k}" for k in kernels]
    means = df.groupBy(*by).agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in sizes])
    total = sum((F.col(c) for c in sizes[1:]), F.col(sizes[0]))
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kernel"), F.col(f"scale_{k}").alias("mean_abs"),
                 F.try_divide(F.col(f"scale_{k}"), total).alias("share"))
        for k in kernels
    ])).alias("_row")
    return means.select(*by, rows).select(*by, "_row.*")


def softmax_weights(df: DataFrame, score: str, by: Sequence[str], name: str = "weight") -> DataFrame:
    """``exp(score)`` over its sum per group, shifted by the maximum against overflow.

    The maximum and the sum come from aggregates, so a large group is never one task.
    """
    keys = list(by)
    top = df.groupBy(*keys).agg(F.max(score).alias("_top"))
    shifted = _attach(df, top, keys).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    total = shifted.groupBy(*keys).agg(F.sum("_e").alias("_sum"))
    return _attach(shifted, total, keys).withColumn(name, F.col("_e") / F.col("_sum")).drop("_e", "_top", "_sum")


def _attach(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    value = [c for c in stats.columns if c not in keys]
    if not keys:
        return df.withColumns({c: stats.select(c).scalar() for c in value})
    return df.join(stats, keys)
