"""Absolute Pearson correlations of all column pairs, in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.quality import numeric_columns

_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
_SUMS_SCHEMA = "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS)


def correlation_with(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Rows ``(left, right, correlation)`` of each column with one other."""
    return _by_expressions(df, [(c, target) for c in columns])


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, method: str = "gram") -> DataFrame:
    """Rows ``(left, right, correlation)`` for each pair, left before right.

    Rows where either side is NULL, NaN or infinite are left out of that pair
    only. A constant column gives NULL. ``gram`` adds up matrix products and fits
    any number of columns, ``expressions`` is one aggregate for a few pairs.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    pairs = list(combinations(names, 2))
    if method == "expressions":
        return _by_expressions(df, pairs)
    if method == "gram":
        return _by_gram(df, names)
    raise ValueError("method must be expressions or gram")


def _finite(name: str) -> Column:
    """The column as a double, NULL where it is NaN or infinite."""
    value = F.col(name).cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def _by_expressions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string, correlation double")
    sums, rows = [], []
    for i, (a, b) in enumerate(pairs):
        x = F.when(_finite(b).isNotNull(), _finite(a))
        y = F.when(_finite(a).isNotNull(), _finite(b))
        spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
        sums.append(F.abs(F.try_divide(F.covar_pop(x, y), spread)).alias(f"_r{i}"))
        rows.append(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_r{i}").alias("correlation")))
    return df.agg(*sums).select(F.explode(F.array(*rows)).alias("_row")).select("_row.*")


def _by_gram(df: DataFrame, names: list[str]) -> DataFrame:
    """Each task adds up the products of its rows as small matrices; the sums of
    all tasks are then added by pair. Values are centred on the column means
    first, so that large levels do not swamp small spreads."""
    width = len(names)
    upper = np.triu_indices(width, k=1)
    numbers = df.select(*[_finite(c).alias(c) for c in names])
    mean = numbers.agg(F.array(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in names])).scalar()
    centred = numbers.withColumn("_mean", mean).select(
        *[(F.col(c) - F.get("_mean", F.lit(i))).alias(f"_x{i}") for i, c in enumerate(names)]
    )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = None
        for batch in batches:
            x = np.column_stack([
                batch.column(k).to_numpy(zero_copy_only=False).astype("float64") for k in range(width)
            ]) if batch.num_rows else np.zeros((0, width))
            seen = ~np.isnan(x)
            x = np.where(seen, x, 0.0)
            mask = seen.astype("float64")
            square = x * x
            products = (mask.T @ mask, x.T @ mask, mask.T @ x, square.T @ mask, mask.T @ square, x.T @ x)
            stacked = np.stack([m[upper] for m in products])
            totals = stacked if totals is None else totals + stacked
        if totals is not None:
            arrays = [pa.array(upper[0].astype("int32")), pa.array(upper[1].astype("int32"))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(t) for t in totals], names=["i", "j", *_SUMS])

    sums = centred.mapInArrow(partial, _SUMS_SCHEMA).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])
    covariance = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    left_spread = F.greatest(F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n")), F.lit(0.0))
    right_spread = F.greatest(F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n")), F.lit(0.0))
    # what is left of a constant column after rounding counts as no spread
    tiny = F.lit(1e-12)
    left_spread = F.when(left_spread > tiny * F.col("sxx"), left_spread)
    right_spread = F.when(right_spread > tiny * F.col("syy"), right_spread)
    table = F.array(*[F.lit(c) for c in names])
    return sums.select(
        F.get(table, F.col("i")).alias("left"),
        F.get(table, F.col("j")).alias("right"),
        F.abs(F.try_divide(covariance, F.sqrt(left_spread) * F.sqrt(right_spread))).alias("correlation"),
    )


def correlated_pairs(pairs: DataFrame, threshold: float = 0.90) -> DataFrame:
    return pairs.where(F.col("correlation") > threshold)


def drop_correlated(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    threshold: float = 0.90,
    drop_first: Sequence[str] = (),
    fit_on: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """Drop those of ``drop_first`` that correlate with any other column.

    With the default nothing is dropped. ``fit_on`` takes the correlations from
    another table, such as the training rows. Runs a job if there is a candidate.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    candidates = [c for c in drop_first if c in names]
    if not candidates:
        return df, []
    found = correlated_pairs(correlation_pairs(fit_on if fit_on is not None else df, names), threshold)
    hit = found.where(F.col("left").isin(candidates) | F.col("right").isin(candidates)).collect()
    dropped = [c for c in candidates if any(c in (r.left, r.right) for r in hit)]
    return df.drop(*dropped), dropped
