"""Exact quantiles and describe by distributed radix selection.

Numbers are longs of the same order (``ordered_key``), taken as four digits of 16 bits.
A round counts, for all groups and wanted ranks in one aggregate, the next digit of the
rows whose leading digits are still in question, and each rank moves on to the digit it
falls on. After four rounds a rank is at one value. No task orders values: a round leaves
at most 65,536 counts for each group and leading digits, whatever the number of rows and
of distinct values between two ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.ordering import ordered_key
from tidegrid.session import write_and_read

DIGIT = 16
ROUNDS = 64 // DIGIT


def quantiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*by, probability, value)``; linear interpolation, NULL and NaN skipped.

    The input is evaluated once: keys of the values are written to the shared folder, and
    rounds read these. What a round asks for is a written table too, so its size is known
    and decides how it is joined to the keys.
    """
    keys = list(by)
    probs = sorted({float(p) for p in probabilities})
    if not probs:
        raise ValueError("no probabilities")
    groups = [F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]
    names = [f"_g{i}" for i in range(len(keys))]
    number = df.select(*groups, F.col(value).cast("double").alias("_v"))
    rows = write_and_read(number.select(*names, ordered_key(F.col("_v")).alias("_key")).where("_key IS NOT NULL"), "keys")

    asked = None
    for step in range(ROUNDS):
        shift = 64 - DIGIT * (step + 1)
        prefix = F.shiftright("_key", min(shift + DIGIT, 63)) if step else F.lit(0).cast("long")
        place = F.shiftright("_key", shift)
        here = rows.select(*names, prefix.alias("_prefix"), place.alias("_place"))
        if step:
            here = _join_on(here, asked.select(*names, "_prefix").distinct(), [*names, "_prefix"])
        counts = here.groupBy(*names, "_prefix", "_place").agg(F.count(F.lit(1)).alias("_n"))
        if not step:
            counts = write_and_read(counts, "digits")
            asked = _ranks(counts, names, probs)
        along = Window.partitionBy(*names, "_prefix").orderBy("_place")
        before = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        spans = counts.withColumn("_before", before)
        found = _join_on(asked, spans, [*names, "_prefix"]).where("_before <= _need AND _need < _before + _n")
        found = found.select(*names, "_p", "_upper", "_rank", F.col("_place").alias("_prefix"), (F.col("_need") - F.col("_before")).alias("_need"))
        asked = write_and_read(found, f"ranks-{step}")

    at = _value_of(F.col("_prefix"))
    ends = asked.groupBy(*names, "_p", "_rank").agg(
        F.max(F.when(~F.col("_upper"), at)).alias("_a"), F.max(F.when(F.col("_upper"), at)).alias("_z")
    )
    between = F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_rank") - F.floor("_rank"))
    exact = F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise(between)
    return ends.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("_p").alias("probability"), exact.alias("value"))


def _ranks(counts: DataFrame, names: list[str], probs: list[float]) -> DataFrame:
    """For each group and probability the rows below and above the wanted rank, counted from 0."""
    totals = counts.groupBy(*names).agg(F.sum("_n").alias("_total"))
    spread = totals.withColumn("_p", F.explode(F.array(*[F.lit(p) for p in probs])))
    spread = spread.withColumn("_rank", F.col("_p") * (F.col("_total") - 1))
    spread = spread.withColumn("_upper", F.explode(F.array(F.lit(False), F.lit(True))))
    need = F.when(F.col("_upper"), F.ceil("_rank")).otherwise(F.floor("_rank"))
    return spread.select(*names, "_p", "_upper", "_rank", F.lit(0).cast("long").alias("_prefix"), need.alias("_need"))


def _value_of(key):
    """The double of an ordered key."""
    bits = F.abs(key)
    exponent, fraction = F.shiftright(bits, 52), bits.bitwiseAND((1 << 52) - 1).cast("double")
    power = F.pow(F.lit(2.0), (F.greatest(exponent, F.lit(1)) - 1023).cast("double"))
    whole = F.when(exponent > 0, 1.0).otherwise(0.0) + fraction * F.lit(2.0**-52)
    size = F.when(exponent == 2047, F.lit(float("inf"))).otherwise(whole * power)
    return F.when(key < 0, -size).otherwise(size)


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample std, min, quartiles, max; one row per group."""
    keys = list(by)
    number = F.col(value).cast("double")
    clean = df.select(*keys, F.when(~F.isnan(number), number).alias("_v"))
    moments = clean.groupBy(*keys).agg(
        F.count("_v").alias("count"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"),
        F.min("_v").alias("min"), F.max("_v").alias("max"),
    )
    quarters = quantiles(clean, "_v", [0.25, 0.5, 0.75], keys).groupBy(*keys).agg(
        *[F.max(F.when(F.col("probability") == q, F.col("value"))).alias(n)
          for n, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
    )
    if not keys:
        moments, quarters, on = moments.withColumn("_one", F.lit(1)), quarters.withColumn("_one", F.lit(1)), ["_one"]
    else:
        on = keys
    return _join_on(moments, quarters, on, "left").select(
        *keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def _join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches NULL keys."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    match = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        match = one if match is None else match & one
    return left.join(renamed, match, how).drop(*[f"_r_{k}" for k in keys])
