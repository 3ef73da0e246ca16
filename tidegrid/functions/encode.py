"""Encodings of text categories."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.calendar import flag
from tidegrid.operators.numbering import number_rows

#: Levels that may become columns of a table.
MAX_COLUMNS = 1000
#: Leading characters that put levels into buckets, in sort order.
_LEAD = 4


def binary_encodes(holiday: str = "holiday", functioning: str = "functioning") -> dict[str, Column]:
    """NULL counts as 0."""
    return {"is_holiday": flag(f"{holiday} = 'Holiday'"), "is_functioning": flag(f"{functioning} = 'Yes'")}


def levels_of(df: DataFrame, column: str, max_levels: int = MAX_COLUMNS) -> list[str]:
    """Sorted levels of a category that are to become columns, which is why a column
    with more than ``max_levels`` is refused. ``factor_codes`` takes any number."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(found) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels, too many for a column each")
    return sorted(row[0] for row in found)


def numbered_levels(df: DataFrame, column: str) -> DataFrame:
    """``level`` and its 0-based ``code`` in sort order, a row for each level that is not NULL."""
    levels = df.select(F.col(column).alias("level")).where("level IS NOT NULL").distinct()
    # leading characters follow the order of the whole text, so levels are numbered lead by lead
    numbered = number_rows(levels, [], F.substring("level", 1, _LEAD), ["level"], "_number")
    return numbered.select("level", (F.col("_number") - 1).cast("int").alias("code"))


def one_hot(column: str, levels: Sequence[str], prefix: str) -> dict[str, Column]:
    """0/1 per level but the first in sort order; NULL gives all zeros."""
    return {
        f"{prefix}_{level}": F.coalesce(F.col(column) == level, F.lit(False)).cast("int") for level in sorted(levels)[1:]
    }


def factor_codes(
    df: DataFrame,
    categories: Sequence[str],
    levels: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Replace text categories by their 0-based code in sort order.

    A category is left alone if it is absent or already has ``<name>_...``
    dummy columns. NULL and unknown levels get the code after the last one.
    Levels that are not given are found, numbered and joined back by Spark,
    however many there are.
    """
    out = df
    for name in categories:
        dummies = [c for c in df.columns if re.match(f"^{re.escape(name)}_", c)]
        if name not in df.columns or dummies:
            continue
        if levels and name in levels:
            known = sorted(levels[name])
            place = F.array_position(F.array(*[F.lit(v) for v in known]), F.col(name)) if known else F.lit(0)
            code = F.coalesce(F.nullif(place, F.lit(0)) - 1, F.lit(len(known)))
        else:
            found = numbered_levels(df, name).withColumnsRenamed({"level": "_level", "code": "_code"})
            after = numbered_levels(df, name).agg(F.coalesce(F.max("code") + 1, F.lit(0))).scalar()
            out = out.join(found, F.col(name) == F.col("_level"), "left")
            code = F.coalesce("_code", after)
        out = out.withColumn(name, code.cast("int")).select(*df.columns)
    return out
