"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Stands for a null id inside an operator: such rows are one document, before all others.
LOWEST = -(1 << 63)
#: Rows whose texts a Python worker turns into objects at the same time.
ROWS = 1_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_in(column: str = "doc_id") -> Column:
    """The id as a long, a null id as the lowest long."""
    return F.coalesce(F.col(f"`{column}`").cast("long"), F.lit(LOWEST)).alias("doc_id")


def id_out(column: str = "doc_id") -> Column:
    return F.nullif(F.col(column), F.lit(LOWEST)).alias(column)


def ids_and_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` (never null) and ``text``; whatever else the table has stays behind."""
    return df.select(id_in(id_col), F.col(f"`{text_col}`").cast("string").alias("text"))


def map_texts(
    df: DataFrame, build: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` with state that ``build`` makes once for each task; a step gets ``ROWS`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = build()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield step(batch.slice(at, ROWS))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column as Python strings, null as the empty string."""
    return [x if x is not None else "" for x in batch.column(name).to_pylist()]


def encoded(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as no bytes."""
    return [x if x is not None else b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


class Recent(dict):
    """What ``find`` gives, remembered for the last ``limit`` to twice ``limit`` different keys.

    Speed only hangs on what is remembered. Keys longer than ``longest`` are found each time.
    """

    def __init__(self, find: Callable[[str], bytes], limit: int, longest: int = 64):
        super().__init__()
        self.find, self.limit, self.longest, self.older = find, limit, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
