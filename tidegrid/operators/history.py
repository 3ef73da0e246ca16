"""Rules on a training history: one row per model and epoch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def early_stop(
    history: DataFrame,
    patience: int = 15,
    by: Sequence[str] = ("model",),
    loss: str = "val_loss",
) -> DataFrame:
    """Where training stops and which epoch is restored.

    Only a strictly lower loss counts as better. Training stops at the first epoch
    that is ``patience`` epochs past the last better one; without such an epoch it
    runs to the end. One model's history is at most its number of epochs.
    """
    order = Window.partitionBy(*by).orderBy("epoch")
    before = F.min(loss).over(order.rowsBetween(Window.unboundedPreceding, -1))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    number = F.row_number().over(order)
    marked = history.withColumn("_n", number).withColumn(
        "_better", before.isNull() | (F.col(loss) < before)
    )
    tracked = marked.withColumn(
        "_best_n", F.last(F.when(F.col("_better"), F.col("_n")), ignorenulls=True).over(so_far)
    ).withColumn("_stop", F.col("_n") - F.col("_best_n") >= patience)
    stopped = tracked.withColumn(
        "_stop_n", F.min(F.when(F.col("_stop"), F.col("_n"))).over(Window.partitionBy(*by))
    ).where(F.col("_stop_n").isNull() | (F.col("_n") <= F.col("_stop_n")))
    return stopped.groupBy(*by).agg(
        F.max("epoch").alias("stop_epoch"),
        F.max(F.when(F.col("_better"), F.col("epoch"))).alias("best_epoch"),
        F.min(loss).alias("best_loss"),
        F.max(F.col("_stop").cast("int")).alias("stopped_early"),
    )


def best_epoch(history: DataFrame, by: Sequence[str] = ("model",), loss: str = "val_loss") -> DataFrame:
    """The first epoch with the lowest loss."""
    return history.groupBy(*by).agg(
        F.min(F.struct(F.col(loss), F.col("epoch"))).alias("_best")
    ).select(*by, F.col("_best.epoch").alias("best_epoch"), F.col(f"_best.{loss}").alias("best_loss"))
