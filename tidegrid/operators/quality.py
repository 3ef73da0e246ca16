"""Missing, infinite, shape and leak checks. Each is one aggregate over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.columns import RAW_TARGET, TARGET

INF = float("inf")
_FRACTIONS = (T.DoubleType, T.FloatType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _fractional(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, _FRACTIONS)}


def is_missing(df: DataFrame, column: str) -> str:
    """SQL: NULL, or NaN where the type has one."""
    missing = f"`{column}` IS NULL"
    return f"({missing} OR isnan(`{column}`))" if column in _fractional(df) else f"({missing})"


def is_infinite(df: DataFrame, column: str) -> str:
    """SQL: infinite; false for NULL and for types without infinity."""
    return f"coalesce(abs(`{column}`) = DOUBLE('infinity'), false)" if column in _fractional(df) else "false"


def _per_column(df: DataFrame, columns: Sequence[str], by: Sequence[str], count, name: str) -> DataFrame:
    """Count per column in one pass, then one row per column."""
    sums = [F.expr(f"count_if({count(df, c)}) AS _c{i}") for i, c in enumerate(columns)]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total_rows"), *sums)
    pairs = ", ".join(f"'{c}', _c{i}" for i, c in enumerate(columns))
    return wide.select(*by, "total_rows", F.expr(f"stack({len(columns)}, {pairs}) AS (column_name, {name})"))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Columns with missing values: count and percent."""
    counts = _per_column(df, columns or df.columns, by, is_missing, "missing")
    share = F.try_divide(F.col("missing") * F.lit(100.0), F.col("total_rows"))
    return counts.where(F.col("missing") > 0).select(*by, "column_name", "missing", share.alias("percent"))


def infinity_counts(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Numeric columns with infinite values."""
    counts = _per_column(df, columns or numeric_columns(df), by, is_infinite, "infinite")
    return counts.where(F.col("infinite") > 0).select(*by, "column_name", "infinite")


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with no NULL or NaN in ``columns`` (all by default).

    One small predicate per column, not one predicate over all of them: they can
    be pushed to a scan one by one, and a later join of the result plans quickly
    (its optimizer rewrites each predicate for every renamed column it holds).
    """
    fractional = _fractional(df)
    tests = [
        f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" if c in fractional else f"`{c}` IS NOT NULL"
        for c in columns or df.columns
    ]
    return df.where(" AND ".join(tests)) if tests else df


def incomplete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How many rows ``drop_incomplete`` drops."""
    any_missing = " OR ".join(is_missing(df, c) for c in columns or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("total_rows"), F.expr(f"count_if({any_missing}) AS dropped_rows"))
    kept = F.col("total_rows") - F.col("dropped_rows")
    return counts.select(
        "total_rows", "dropped_rows", kept.alias("kept_rows"),
        F.try_divide(F.col("dropped_rows") * F.lit(100.0), F.col("total_rows")).alias("dropped_percent"),
    )


def infinite_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    wanted = [c for c in (columns or numeric_columns(df)) if c in _fractional(df)]
    return df.withColumns({c: F.expr(f"IF({is_infinite(df, c)}, NULL, `{c}`)") for c in wanted})


def drop_infinite(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that are complete and finite in ``columns`` (all by default): the same
    as turning infinities into NULL and dropping incomplete rows.

    Each column stands once in the tests, as a filter of computed columns computes them by itself."""
    fractional = _fractional(df)
    tests = [
        f"abs(`{c}`) < DOUBLE('infinity')" if c in fractional else f"`{c}` IS NOT NULL"
        for c in columns or df.columns
    ]
    return df.where(" AND ".join(tests)) if tests else df


def value_totals(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Aggregates ``missing`` and ``infinite``: values of that kind over all columns."""
    def total(test) -> str:
        return " + ".join(f"CAST({test(df, c)} AS BIGINT)" for c in columns)

    return [F.expr(f"sum({total(is_missing)}) AS missing"), F.expr(f"sum({total(is_infinite)}) AS infinite")]


def split_totals(df: DataFrame, by: Sequence[str] = ("split",), columns: Sequence[str] | None = None) -> DataFrame:
    """Missing and infinite values over all columns, per split."""
    wanted = list(columns) if columns else [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(*value_totals(df, wanted))


def split_consistency(train: DataFrame, test: DataFrame) -> DataFrame:
    """Per column: present on each side, and values on each side."""

    def side(df: DataFrame, name: str) -> DataFrame:
        present = _per_column(df, df.columns, (), lambda d, c: f"NOT {is_missing(d, c)}", f"{name}_values")
        return present.select(F.col("column_name").alias(f"{name}_column"), f"{name}_values")

    pairs = side(train, "train").join(
        side(test, "test"), F.col("train_column") == F.col("test_column"), "full_outer"
    )
    return pairs.select(
        F.coalesce("train_column", "test_column").alias("column_name"),
        F.col("train_column").isNotNull().cast("int").alias("in_train"),
        F.col("test_column").isNotNull().cast("int").alias("in_test"),
        F.coalesce("train_values", F.lit(0)).alias("train_values"),
        F.coalesce("test_values", F.lit(0)).alias("test_values"),
    )


def shapes(stages: dict[str, DataFrame], base: str, parts: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Rows, columns and percent of the ``base`` stage for each named stage, each stage read once.

    ``parts`` names rows of a stage as stages of their own: the stage and a condition in
    SQL. They are counted in the same pass.
    """
    out = None
    for name, df in stages.items():
        own = {part: test for part, (stage, test) in (parts or {}).items() if stage == name}
        counts = [F.count(F.lit(1)).alias("_n0"), *[F.expr(f"count_if({t})").alias(f"_n{i}") for i, t in enumerate(own.values(), 1)]]
        pairs = ", ".join(f"'{stage}', _n{i}" for i, stage in enumerate([name, *own]))
        row = df.agg(*counts).select(
            F.expr(f"stack({len(own) + 1}, {pairs}) AS (stage, row_count)"), F.lit(len(df.columns)).alias("column_count"))
        out = row if out is None else out.unionByName(row)
    # one row per stage
    whole = F.max(F.when(F.col("stage") == base, F.col("row_count"))).over(Window.partitionBy(F.lit(0)))
    return out.withColumn("retained_percent", F.try_divide(F.col("row_count") * F.lit(100.0), whole))


def leaks(
    df: DataFrame,
    features: Sequence[str],
    target: str = TARGET,
    target_names: Sequence[str] = (TARGET, RAW_TARGET),
    raise_on_leak: bool = False,
) -> DataFrame:
    """One row per feature: does it have a target's name, or the target's values?

    An empty table has no value leaks. ``raise_on_leak`` runs the check and raises.
    """
    names = {n.lower() for n in target_names}
    equal = [
        F.every(F.col(f).cast("double").eqNullSafe(F.col(target).cast("double"))).alias(f"_e{i}")
        if isinstance(df.schema[f].dataType, T.NumericType) else F.every(F.lit(False)).alias(f"_e{i}")
        for i, f in enumerate(features)
    ]
    wide = df.agg(*equal)
    rows = wide.select(F.explode(F.array(*[
        F.struct(
            F.lit(f).alias("feature"),
            F.lit(int(f.lower() in names)).alias("name_leak"),
            F.coalesce(F.col(f"_e{i}"), F.lit(False)).cast("int").alias("value_leak"),
        )
        for i, f in enumerate(features)
    ])).alias("_row")).select("_row.*")
    out = rows.withColumn("leaked", F.greatest("name_leak", "value_leak"))
    if raise_on_leak:
        found = [r.feature for r in out.where("leaked = 1").collect()]
        if found:
            raise ValueError(f"target leaks into features: {found}")
    return out
