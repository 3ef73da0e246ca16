"""Train, test and validation splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.hashing import hash_bucket, key_hash
from tidegrid.operators.numbering import number_in_series
from tidegrid.operators.quantiles import quantiles
from tidegrid.timeline import Timeline


def split_at_date(df: DataFrame, date: str, at: str, name: str = "split") -> DataFrame:
    """``train`` before the date, ``test`` from it on. Apply after the windows."""
    return df.withColumn(name, F.when(F.col(date) < F.lit(at).cast("date"), "train").otherwise("test"))


def split_after_months(df: DataFrame, date: str, months: int = 9, name: str = "split") -> DataFrame:
    """The split date is ``months`` after the first date, clamped at month ends."""
    at = df.agg(F.add_months(F.min(date), months)).scalar()
    return df.withColumn(name, F.when(F.col(date) < at, "train").otherwise("test"))


def split_stratified(
    df: DataFrame,
    target: str,
    keys: Sequence[str],
    share: float = 0.75,
    bins: int = 4,
    seed: int = 42,
    hashed: Column | None = None,
    bits: int = 64,
    name: str = "split",
) -> DataFrame:
    """Random split that draws ``ceil(share * n)`` rows in every quantile bin of ``target``.

    Rows are drawn in the order of a hash of ``keys`` (unique per row). Instead of
    ranking whole bins, the hash range is counted in buckets; only the bucket that
    holds the cut of a bin is ranked, and that yields one cut key per bin. The cut
    table has at most ``bins`` rows, which is why it may be broadcast. Rows with a
    NULL target get a NULL split.
    """
    probabilities = [i / bins for i in range(bins + 1)]
    wide = quantiles(df.select(F.col(target).cast("double").alias("_y")), "_y", probabilities)
    breaks = wide.agg(F.array_sort(F.collect_list("value"))).scalar()
    y = F.col(target).cast("double")
    # a bin starts at each break that differs from the one before and from the last
    inner = [
        f"IF(_breaks[{i}] > _breaks[{i - 1}] AND _breaks[{i}] < _breaks[{bins}] AND _y > _breaks[{i}], 1, 0)"
        for i in range(1, bins)
    ]
    stratum = F.expr(f"IF(_y IS NOT NULL, {' + '.join(inner) or '0'}, NULL)")
    place = F.struct((hashed if hashed is not None else key_hash(keys, seed)).alias("h"), *keys)
    rows = df.withColumns({"_y": y, "_breaks": breaks}).withColumns({"_stratum": stratum, "_place": place})
    ranked = rows.select("_stratum", "_place", hash_bucket(F.col("_place.h"), bits).alias("_bucket"))
    ranked = ranked.where(F.col("_stratum").isNotNull())

    counts = ranked.groupBy("_stratum", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("_stratum").orderBy("_bucket")
    edges = (
        counts.select(
            "_stratum", "_bucket", "_n",
            F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
            F.ceil(F.lit(share) * F.sum("_n").over(Window.partitionBy("_stratum"))).alias("_need"),
        )
        .where((F.col("_before") < F.col("_need")) & (F.col("_need") <= F.col("_before") + F.col("_n")))
        .select("_stratum", "_bucket", (F.col("_need") - F.col("_before")).alias("_left"))
    )
    in_edge = ranked.join(F.broadcast(edges), ["_stratum", "_bucket"])
    number = F.row_number().over(Window.partitionBy("_stratum", "_bucket").orderBy("_place"))
    cuts = (
        in_edge.withColumn("_number", number)
        .where(F.col("_number") == F.col("_left"))
        .select("_stratum", F.col("_place").alias("_cut"))
    )
    drawn = F.when(F.col("_place") <= F.col("_cut"), "train").otherwise("test")
    return (
        rows.join(F.broadcast(cuts), "_stratum", "left")
        .withColumn(name, F.when(F.col("_stratum").isNotNull(), drawn))
        .select(*df.columns, name)
    )


def split_tail(
    df: DataFrame,
    timeline: Timeline,
    fraction: float = 0.2,
    within: Sequence[str] = (),
    name: str = "role",
) -> DataFrame:
    """The last ``floor(fraction * n)`` rows of every series are ``validation``.

    A series too short to give one validation row is all ``train``.
    """
    numbered = number_in_series(df, timeline, within, "_number", "_total")
    first = F.col("_total") - F.floor(F.lit(fraction) * F.col("_total"))
    return numbered.withColumn(
        name, F.when(F.col("_number") > first, "validation").otherwise("train")
    ).drop("_number", "_total")
