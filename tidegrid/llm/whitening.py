"""Embedding whitening by an incremental eigendecomposition.

Every partition follows the eigenvalues and eigenvectors of the scatter of its rows by
centred rank-one updates (``spectrum``: secular equation, deflation). The spectra of
partitions are combined in groups of ``FAN_IN``, level by level, again by rank-one
updates, until one is left. Its vectors are the basis of a last pass over all rows
(Rayleigh-Ritz): the covariance in that basis is all but diagonal, is summed up from
exactly centred rows, and turns the basis into the components. So what rounding the many
updates left behind is gone, whatever their order. Nothing that leaves a task is larger
than a matrix of the vectors' dimension.

Rows count with their vector ``x = floor(1024 c) + 100000`` of whole numbers, so counts
and sums are exact at any size. A row is left out where the vector is null, holds a null,
NaN or infinity, or has another length than the most frequent one (the greatest of equally
frequent ones), as it has no place among the others. Entries beyond 2**52 count as 2**52
in size. Repeated rows and ids count each; null ids stay null. An empty table gives no
rows. A component without variance (rank below the dimension) has ``whitened`` null and
explains 0. A ``deviation`` that no long can hold is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import ROWS
from tidegrid.llm.spectrum import EPS, Spectrum
from tidegrid.session import write_and_read

SCALE, OFFSET, LARGEST = 1024.0, 100_000, 2.0**52
#: Spectra or sums that one task combines.
FAN_IN = 8
LONG = 2**63 - 1
STATE = "part long, n long, sums array<string>, numbers array<double>"
OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


class Whitening(NamedTuple):
    """What a fit gives: exact count and sums, components as columns, their variances, the whole variance.

    ``levels`` is the depth of the tree that combines what the partitions give.
    """

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    levels: int = 1

    def scales(self) -> np.ndarray:
        """Of each component the factor to unit variance; NaN where there is no variance."""
        real = self.variances > 64 * EPS * max(len(self.sums), 1) * self.trace
        return np.where(real, 1 / np.sqrt(np.where(real, self.variances, 1)), np.nan)


def vectors(df: DataFrame, vector_col: str = "embedding", dimension: int | None = None, id_col: str | None = None) -> DataFrame:
    """``v`` (and ``vec_id``) of the rows whose vector is whole and of the given (or most frequent) length."""
    ids = [F.col(f"`{id_col}`").cast("long").alias("vec_id")] if id_col else []
    rows = df.select(*ids, F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    inf = F.lit(float("inf"))
    rows = rows.where(F.coalesce(F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < inf)), F.lit(False)))
    if dimension is None:
        sizes = rows.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).limit(1).collect()
        dimension = sizes[0].k if sizes else 0
    return rows.where(F.size("v") == dimension)


def _blocks(batch: pa.RecordBatch, dimension: int, rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their whole-number vectors as longs."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        flat = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
        whole = np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST)
        yield part, whole.astype(np.int64) + OFFSET


def _exact_sums(x: np.ndarray) -> list[int]:
    if float(np.abs(x).max()) * len(x) < 2.0**62:
        return x.sum(0).tolist()
    return [sum(column) for column in x.T.tolist()]


def _state(n: int, sums: list[int], numbers: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64())]
    columns += [pa.array([[str(s) for s in sums]], pa.list_(pa.string())), pa.array([numbers.ravel()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, ["part", "n", "sums", "numbers"])


def _packed(s: Spectrum) -> np.ndarray:
    return np.concatenate([s.mean, s.values, s.vectors.ravel()])


def _unpacked(n: int, numbers: np.ndarray) -> Spectrum:
    d = round((1 + len(numbers)) ** 0.5) - 1
    s = Spectrum(d)
    s.n, s.mean, s.values, s.vectors = n, numbers[:d], numbers[d : 2 * d], numbers[2 * d :].reshape(d, d)
    return s


def _combined(states: DataFrame, levels: int, merge: Callable[[list[tuple[int, np.ndarray]]], np.ndarray]) -> DataFrame:
    """One state from many: ``FAN_IN`` of them at a time, whole numbers added, the others by ``merge``."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("part").combine_chunks()
        part, counts = group.column("part")[0].as_py() // FAN_IN, group.column("n").to_pylist()
        sums = [str(sum(map(int, column))) for column in zip(*group.column("sums").to_pylist())]
        numbers = merge([(n, np.array(x.as_py())) for n, x in zip(counts, group.column("numbers"))])
        return pa.table(
            {"part": [part], "n": [sum(counts)], "sums": [sums], "numbers": [numbers]}, schema=group.schema
        )

    for _ in range(levels):
        states = states.groupBy(F.floor(F.col("part") / FAN_IN).alias("_next")).applyInArrow(run, STATE)
    return states


def _added(parts: list[tuple[int, np.ndarray]]) -> np.ndarray:
    return np.sum([x for _, x in parts], axis=0)


def _joined(parts: list[tuple[int, np.ndarray]]) -> np.ndarray:
    first, *others = (_unpacked(n, x) for n, x in parts)
    for other in others:
        first.merge(other)
    return _packed(first)


def _levels(parts: int) -> int:
    return max(1, ceil(log(max(parts, 2), FAN_IN) - 1e-9))


def _spectra(rows: DataFrame, dimension: int, fold: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, sums = Spectrum(dimension), [0] * dimension
        for batch in batches:
            for _, x in _blocks(batch, dimension, fold):
                sums = [a + b for a, b in zip(sums, _exact_sums(x))]
                if fold == 1:
                    spectrum.add(x[0] - float(OFFSET))
                else:
                    spectrum.add_block(x - float(OFFSET))
        if spectrum.n:
            yield _state(spectrum.n, sums, _packed(spectrum))

    return rows.mapInArrow(run, STATE)


def _centre(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as a whole number and the rest, so that centring loses nothing."""
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


def _scatter(rows: DataFrame, levels: int, n: int, sums: tuple[int, ...], basis: np.ndarray) -> np.ndarray | None:
    """Sums of the centred rows in a basis and of their products, over all rows: first row and the rest of the matrix."""
    whole, rest = _centre(n, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, seen = basis.shape[1], 0
        total = np.zeros((k + 1, k))
        for batch in batches:
            for _, x in _blocks(batch, len(whole), ROWS):
                y = ((x - whole) - rest) @ basis
                total[0] += y.sum(0)
                total[1:] += y.T @ y
                seen += len(y)
        if seen:
            yield _state(seen, [], total)

    done = _combined(rows.mapInArrow(run, STATE), levels, _added).collect()
    return sum(np.array(r.numbers) for r in done).reshape(-1, basis.shape[1]) if done else None


def fit(df: DataFrame, components: int = 8, fold: int = 512, vector_col: str = "embedding", dimension: int | None = None) -> Whitening | None:
    """Count, sums and components of all vectors (None without any).

    ``fold`` rows are turned into at most ``dimension`` updates; 1 adds every row by an update of its own.
    """
    rows = vectors(df, vector_col, dimension)
    first = rows.select(F.size("v").alias("k")).limit(1).collect()
    if not first or not first[0].k:
        return None
    states = write_and_read(_spectra(rows, first[0].k, fold), "spectra")
    levels = _levels(states.agg(F.max("part")).collect()[0][0] + 1)
    state = _combined(states, levels, _joined).collect()[0]
    spectrum, n, sums = _unpacked(state.n, np.array(state.numbers)), state.n, tuple(int(s) for s in state.sums)
    basis, _ = np.linalg.qr(spectrum.vectors[:, ::-1])
    products = _scatter(rows, levels, n, sums, basis)
    mean = products[0] / n
    covariance = products[1:] / n - np.outer(mean, mean)
    values, turn = np.linalg.eigh((covariance + covariance.T) / 2)
    values, turn = np.maximum(values[::-1], 0), turn[:, ::-1]
    return Whitening(n, sums, (basis @ turn)[:, :components], values[:components], float(values.sum()), levels)


def identity_error(df: DataFrame, model: Whitening, vector_col: str = "embedding") -> float | None:
    """Largest entry of the covariance of the whitened rows minus the identity, over components with variance."""
    scales = model.scales()
    real = ~np.isnan(scales)
    if not real.any():
        return None
    rows = vectors(df, vector_col, len(model.sums))
    products = _scatter(rows, model.levels, model.n, model.sums, model.components[:, real] * scales[real])
    mean = products[0] / model.n
    return float(np.abs(products[1:] / model.n - np.outer(mean, mean) - np.eye(int(real.sum()))).max())


def whiten(df: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per remaining row and component: ``vec_id, component, n, deviation, whitened, explained``."""
    if model is None:
        return df.sparkSession.createDataFrame([], OUTPUT)
    n, sums, dimension = model.n, model.sums, len(model.sums)
    scales, k = model.scales(), model.components.shape[1]
    basis = model.components * np.where(np.isnan(scales), 0, scales)
    whole, rest = _centre(n, sums)
    explained = model.variances / model.trace if model.trace > 0 else np.zeros(k)
    largest = max(abs(s) for s in sums)

    def deviations(x: np.ndarray) -> list[int | None]:
        if n * float(np.abs(x).max()) + largest < 2.0**62:
            off = n * x - np.array(sums, np.int64)
            if dimension * float(np.abs(off).max()) ** 2 < 2.0**62:
                return (off * off).sum(1).tolist()
        exact = (sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist())
        return [e if e <= LONG else None for e in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _blocks(batch, dimension, ROWS):
                y = ((x - whole) - rest) @ basis
                ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
                off = pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(ids), n)), off,
                        pa.array(y.ravel(), mask=np.tile(np.isnan(scales), len(x))), pa.array(np.tile(explained, len(x))),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    return vectors(df, vector_col, dimension, id_col).mapInArrow(run, OUTPUT)
