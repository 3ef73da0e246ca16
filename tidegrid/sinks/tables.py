"""Table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.regression import GBTRegressionModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.columns import HEADER_OF, RAW_TARGET, TARGET
from tidegrid.operators.numbering import number_in_series
from tidegrid.session import COMPILED, settings
from tidegrid.timeline import Timeline

#: A file for each split is open in a task, so wide rows are not sorted by split before they are written.
_WRITING = {**COMPILED, "spark.sql.maxConcurrentOutputFileWriters": "8"}


def _csv_ready(df: DataFrame) -> DataFrame:
    """Reference headers, and one-hot columns as True/False."""
    out = []
    for name in df.columns:
        column = F.col(name)
        if name.startswith("Season_"):
            column = F.when(column == 1, "True").when(column == 0, "False")
        out.append(column.alias(HEADER_OF.get(name, name)))
    return df.select(*out)


def write_split_csv(df: DataFrame, path: str, split: str = "split") -> tuple[str, str]:
    """CSV folders for train and test below ``path``, in one pass over the rows; files are compressed, a task's rows each."""
    with settings(df.sparkSession, _WRITING):
        _csv_ready(df).write.mode("overwrite").partitionBy(split).options(header=True, compression="gzip").csv(path)
    return f"{path}/{split}=train", f"{path}/{split}=test"


def write_split_parquet(df: DataFrame, path: str, split: str = "split") -> str:
    """The default sink: one table, one folder per split, pruned on read."""
    with settings(df.sparkSession, _WRITING):
        df.write.mode("overwrite").partitionBy(split).parquet(path)
    return path


def write_raw_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> str:
    """The raw table under its original headers and date format."""
    dated = df.withColumn("date", F.date_format("date", "dd/MM/yyyy"))
    _csv_ready(dated).write.mode("overwrite").options(header=True, encoding=encoding).csv(path)
    return path


def write_manifest(df: DataFrame, path: str, exclude: Sequence[str] = ()) -> list[str]:
    """Feature names, one per line, in column order, without the targets."""
    left_out = {TARGET, RAW_TARGET, *exclude}
    names = [c for c in df.columns if c not in left_out]
    lines = df.sparkSession.createDataFrame([(i, HEADER_OF.get(n, n)) for i, n in enumerate(names)], "i int, value string")
    lines.coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)
    return names


def long_predictions(df: DataFrame, timeline: Timeline, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """A row per prediction; ``by`` names further keys, such as the model and the split."""
    return df.select(*by, *timeline.keys, F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))


def wide_predictions(df: DataFrame, timeline: Timeline, actual: str, predicted: str, split: str = "split") -> DataFrame:
    """Train and test side by side per series, row for row; the shorter side is NULL."""
    numbered = number_in_series(df, timeline, [split], "row_number")
    values = []
    for role in ("train", "test"):
        for name, value in (
            ("actual", F.col(actual)), ("predicted", F.col(predicted)), ("residuals", F.col(actual) - F.col(predicted)),
        ):
            values.append(F.max(F.when(F.col(split) == role, value)).alias(f"{name}_{role}"))
    # a row number occurs once per side, so an aggregate pairs the sides in one pass
    return numbered.groupBy(*timeline.series, "row_number").agg(*values)


def write_scaler(stats: DataFrame, path: str) -> str:
    stats.write.mode("overwrite").parquet(path)
    return path


def save_model(model: GBTRegressionModel | MLWritable, path: str) -> str:
    model.write().overwrite().save(path)
    return path
