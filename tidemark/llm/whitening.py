"""Whitening of embeddings along leading components of their covariance.

Entries are put on an integer grid, so counts, sums and products of all vectors are exact
whatever the order of tasks. The covariance, as large as the dimension squared, is all that
the driver sees; its leading eigenpairs come from spectrum slicing (``spectrum.leading``).
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import table_batch
from tidemark.llm.spectrum import leading
from tidemark.llm.vectors import matrix, usable_vectors

#: Steps of the grid in 1.0, and the shift that a contract may add to every entry.
GRID = 64
#: Entries beyond this many steps are held at it.
FARTHEST = 1 << 40
ROWS = 2048
LONG = (1 << 63) - 1


def on_grid(v: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(v * GRID), -FARTHEST, FARTHEST).astype(np.int64)


def exact_products(y: np.ndarray) -> np.ndarray:
    """yᵀ y in whole numbers: by doubles while these are exact, else by long arithmetic."""
    most = int(np.abs(y).max()) ** 2 if y.size else 0
    rows = (1 << 53) // max(most, 1)
    if rows < 1:
        return y.astype(object).T @ y.astype(object)
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), rows):
        part = y[at:at + rows].astype(float)
        total = total + (part.T @ part).astype(np.int64)
    return total


@dataclass
class Whitening:
    """Count, exact sums, eigenvalues (falling), unit axes as columns, trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * y - sums, exact: 64-bit numbers where they hold it."""
        most = self.n * max(int(np.abs(y).max()) if y.size else 0, 1) + max(abs(s) for s in self.sums)
        kind = np.int64 if most < 1 << 62 else object
        return y.astype(kind) * self.n - np.array(self.sums, kind)

    def whitened(self, off: np.ndarray) -> np.ndarray:
        return (off.astype(float) / self.n) @ self.axes / np.sqrt(self.values)


def deviations(off: np.ndarray) -> pa.Array:
    """Sum of squares of each row, exact; null where it does not fit a long."""
    most = max(abs(int(off.max())), abs(int(off.min()))) if off.size else 0
    if most * most * off.shape[1] <= LONG:
        return pa.array((off.astype(np.int64) ** 2).sum(axis=1), pa.int64())
    return pa.array([s if s <= LONG else None for s in (off.astype(object) ** 2).sum(axis=1)], pa.int64())


def fit_whitening(table: DataFrame, width: int, components: int = 32) -> Whitening | None:
    """One pass over all vectors; None for a table without vectors.

    A task adds up its own rows and returns a number for every pair of dimensions; equal pairs
    are summed by Spark, with exact decimals.
    """
    i, j = np.triu_indices(width)

    def run(batches):
        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            y = on_grid(matrix(batch.column(0), width))
            n += len(y)
            sums = sums + y.sum(axis=0)
            products = products + exact_products(y)
        schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", pa.decimal128(38, 0))])
        if n:
            total = [n, *sums.tolist(), *products[i, j].tolist()]
            yield table_batch([np.r_[-1, np.arange(width), i], np.r_[-1, np.full(width, -1), j],
                               pa.array([int(t) for t in total], pa.decimal128(38, 0))], schema)

    parts = table.select("_v").mapInArrow(run, "i int, j int, total decimal(38,0)")
    found = {(r.i, r.j): int(r.total) for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    if not found:
        return None
    n, sums = found[-1, -1], [found[d, -1] for d in range(width)]
    # Whole numbers to the end: the centred products of all vectors, divided once.
    cov = np.zeros((width, width))
    for a, b in zip(i.tolist(), j.tolist()):
        cov[a, b] = cov[b, a] = (n * found[a, b] - sums[a] * sums[b]) / (n * n)
    values, axes = leading(cov, components)
    return Whitening(n, sums, values, axes, float(np.trace(cov)))


def identity_error(table: DataFrame, width: int, model: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, measured over all of them."""
    k = len(model.values)

    def run(batches):
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whitened(model.centred(on_grid(matrix(batch.column(0), width))))
            sums += w.sum(axis=0)
            products += w.T @ w
        schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", pa.float64())])
        i, j = np.triu_indices(k)
        yield table_batch([np.r_[np.arange(k), i], np.r_[np.full(k, -1), j], np.r_[sums, products[i, j]]], schema)

    parts = table.select("_v").mapInArrow(run, "i int, j int, total double")
    found = {(r.i, r.j): r.total for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    mean = np.array([found[a, -1] for a in range(k)]) / model.n
    return max(abs(found[a, b] / model.n - mean[a] * mean[b] - (a == b)) for a in range(k) for b in range(a, k))


def whiten(table: DataFrame, components: int = 32, name: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(name, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    Vectors that are null or hold null or non-finite entries are left out, those of an unusual
    length too (``usable_vectors``). Repeated rows and ids, null ids among them, count and come
    back as often as they occur; other columns are not looked at. Components whose eigenvalue
    rounding cannot tell from zero do not exist: a single vector, or equal ones only, give no
    rows, like an empty table. Entries are held within ±2^34, a deviation beyond 2^63 is null.
    Three passes over the table, no shuffle but of sums; nothing is kept on executors.
    """
    found, width = usable_vectors(table, name, vector)
    kind = found.schema[0].dataType.simpleString()
    shape = f"`{name}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit_whitening(found, width, components) if width else None
    if model is None or not len(model.values):
        return table.sparkSession.createDataFrame([], shape)
    error = identity_error(found, width, model)
    k, explained = len(model.values), model.values / model.trace

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                off = model.centred(on_grid(matrix(part.column(1), width)))
                rows = len(off)
                place = pa.array(np.repeat(np.arange(rows), k))
                columns = [part.column(0).take(place), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                           pa.array(np.full(rows * k, model.n)), deviations(off).take(place),
                           pa.array(model.whitened(off).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names=[name, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return found.mapInArrow(run, shape)
