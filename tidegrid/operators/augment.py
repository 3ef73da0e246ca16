"""Training-row augmentation: noise and two kinds of mixup.

All draws come from hashes of the row key and a seed, so a lost task that runs
again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidegrid.functions.hashing import gaussian, key_hash, uniform
from tidegrid.operators.numbering import number_by_hash


def add_noise(df: DataFrame, features: Sequence[str], keys: Sequence[str], sigma: float = 0.02, seed: int = 42) -> DataFrame:
    """``x + N(0, sigma)`` on every feature, independent per row and feature."""
    return df.withColumns({
        f: F.col(f) + F.lit(float(sigma)) * gaussian([*keys, F.lit(j)], seed) for j, f in enumerate(features)
    })


def _splitmix(state: np.ndarray) -> np.ndarray:
    # public-domain SplitMix64 finaliser; its three constants are fixed values
    z = state + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def beta_draw(hashed: Column, alpha: float) -> Column:
    """One symmetric Beta(alpha, alpha) value per row by Johnk's rejection, in batches."""

    @pandas_udf("double")
    def draw(seeds: pd.Series) -> pd.Series:
        state = seeds.to_numpy(dtype="int64").view("uint64").copy()
        out = np.full(len(state), np.nan)
        todo = np.arange(len(state))
        with np.errstate(over="ignore"):
            while len(todo):
                first = _splitmix(state[todo])
                second = _splitmix(first)
                state[todo] = second
                # on the log scale, as u ** (1 / alpha) underflows for small alpha
                a = np.log(((first >> np.uint64(11)).astype("float64") + 0.5) / 2**53) / alpha
                b = np.log(((second >> np.uint64(11)).astype("float64") + 0.5) / 2**53) / alpha
                total = np.logaddexp(a, b)
                good = total <= 0
                out[todo[good]] = np.exp(a[good] - total[good])
                todo = todo[~good]
        return pd.Series(out)

    return draw(hashed)


def _mix(features: Sequence[str], target: str, weight: Column) -> dict[str, Column]:
    return {
        c: weight * F.col(c).cast("double") + (1 - weight) * F.col(f"_other.{c}").cast("double")
        for c in [*features, target]
    }


def mixup_pairs(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    keys: Sequence[str],
    alpha: float = 0.2,
    probability: float = 0.5,
    seed: int = 42,
    order: Column | None = None,
    bits: int = 64,
    chance: Column | None = None,
    partner: Column | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """With ``probability`` mix a row with a uniformly drawn one; else keep it.

    Rows are numbered by hash; the partner is looked up by number in an equi-join.
    Every number occurs once, so no partner key is hot on the build side and a
    partner number is drawn about once. Both sides are as long as the table, whatever
    its files' sizes let the planner expect, so they are merged, never broadcast. ``order``, ``chance`` (0 to 1), ``partner``
    (a non-negative integer) and ``weight`` replace the hashed draws.
    """
    order = order if order is not None else key_hash(keys, seed)
    chance = chance if chance is not None else uniform(keys, seed + 1)
    partner = partner if partner is not None else F.shiftrightunsigned(key_hash(keys, seed + 2), 1)
    weight = weight if weight is not None else beta_draw(key_hash(keys, seed + 3), alpha)
    numbered = number_by_hash(df, [], order, bits, keys, "_number", "_total")
    drawn = numbered.withColumn("_mixed", chance < probability).withColumn(
        "_partner", F.when(F.col("_mixed"), F.pmod(partner, F.col("_total")) + 1)
    )
    others = numbered.select(
        F.col("_number").alias("_partner_number"), F.struct(*features, target).alias("_other")
    ).hint("merge")
    joined = drawn.where(F.col("_mixed")).join(others, F.col("_partner") == F.col("_partner_number"))
    mixed = joined.withColumn("_w", weight).withColumns(_mix(features, target, F.col("_w")))
    as_is = drawn.where(~F.col("_mixed")).withColumns({c: F.col(c).cast("double") for c in [*features, target]})
    columns = [*df.columns, F.col("_mixed").cast("int").alias("mixed")]
    return mixed.select(*columns).unionByName(as_is.select(*columns))


def mixup_batches(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    keys: Sequence[str],
    batch_rows: int = 64,
    alpha: float = 0.1,
    seed: int = 42,
    order: Column | None = None,
    shuffle: Column | None = None,
    bits: int = 64,
    weight: Column | None = None,
) -> DataFrame:
    """One weight per batch; each row mixes with the row its batch's permutation gives.

    The short last batch is dropped, as in training. A batch is ``batch_rows``
    rows, so ranking inside it is bounded. ``weight`` may use the column ``batch``.
    """
    order = order if order is not None else key_hash(keys, seed)
    shuffle = shuffle if shuffle is not None else key_hash(keys, seed + 1)
    weight = weight if weight is not None else beta_draw(key_hash(["batch"], seed + 2), alpha)
    numbered = number_by_hash(df, [], order, bits, keys, "_number", "_total")
    number = F.col("_number") - 1
    batched = numbered.withColumn("batch", F.floor(number / batch_rows).cast("long")).where(
        (F.col("batch") + 1) * batch_rows <= F.col("_total")
    )
    inside = Window.partitionBy("batch")
    placed = batched.withColumns({
        "_place": F.pmod(number, F.lit(batch_rows)).cast("int"),
        "_drawn": (F.row_number().over(inside.orderBy(shuffle, *keys)) - 1).cast("int"),
    })
    others = placed.select(
        F.col("batch").alias("_other_batch"), F.col("_drawn").alias("_other_place"),
        F.struct(*features, target).alias("_other"),
    ).hint("merge")
    joined = placed.join(others, (F.col("batch") == F.col("_other_batch")) & (F.col("_place") == F.col("_other_place")))
    return joined.withColumn("_w", weight).withColumns(_mix(features, target, F.col("_w"))).select(*df.columns, "batch")
