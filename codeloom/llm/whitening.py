"""Whitening of embeddings by their principal components, with moments merged by Chan's formula.

Entries c become whole numbers x = floor(256 * c). The fit list is each distinct x vector once.
Each task sums its part of the list up to (count, sums, mean, scatter around the own mean), and
parts are merged two by two in a tree: the scatter of a union is the sum of both scatters and
of the outer product of the means' difference, weighted. The driver gets one such summary of
d * d numbers and finds the components; a second pass over the fit list takes the same summary
of the whitened vectors, whose covariance must be the identity.

Defined results: rows whose vector is null, holds a null or non-finite entry, or an entry of 2**55
or more in size (whose x is no 64-bit number), are dropped; equal vectors count once in the fit, but each row has its
result; null and repeated ids are kept as any others; vectors of different lengths are of different
spaces, each fitted by itself; a vector of fewer than ``components`` entries has as many components
as entries, an empty one none; a component whose variance is zero to rounding has null for
``whitened`` (nothing can be divided by it) and is left out of the identity; ``explained`` is null
where all vectors are equal; ``deviation`` is null where it needs more than 64 bits; an empty table gives an
empty result; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import stored, take

#: Steps of a unit in a whole number.
SCALE = 256
LARGEST = float(1 << 55)


@dataclass
class Moments:
    """Of some vectors of one length: how many, sums of whole entries (exact), mean, and scatter around it."""

    n: int
    sums: np.ndarray | None
    mean: np.ndarray
    scatter: np.ndarray

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        apart = other.mean - self.mean
        sums = None if self.sums is None else self.sums + other.sums
        return Moments(n, sums, self.mean + apart * (other.n / n), self.scatter + other.scatter + np.outer(apart, apart) * (self.n * (other.n / n)))


def merged(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    """Moments by length of vector; a length that only one side has stays as it is."""
    return {d: a[d].merged(b[d]) if d in a and d in b else a.get(d) or b[d] for d in (*a, *(d for d in b if d not in a))}


def moments(values: np.ndarray, whole: np.ndarray | None = None) -> Moments:
    """Of the rows of ``values``; sums of ``whole`` are taken in two halves of 32 bits, so they can't overflow."""
    mean = values.mean(axis=0)
    centred = values - mean
    sums = None
    if whole is not None:
        high, low = (whole >> 32).sum(axis=0), (whole & 0xFFFFFFFF).sum(axis=0)
        sums = np.array([(int(h) << 32) + int(v) for h, v in zip(high, low, strict=True)], object)
    return Moments(len(values), sums, mean, centred.T @ centred)


def _matrices(column: pa.Array):
    """(length, rows, matrix) of the lists of each length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        yield d, rows, flat[start[rows][:, None] + np.arange(d)]


def _merged_over(df: DataFrame, summed) -> dict[int, Moments]:
    """``summed`` (batch -> moments by length) of every batch, merged in each task, then by pairs of tasks in a tree."""

    def run(batches):
        total: dict[int, Moments] = {}
        for batch in batches:
            total = merged(total, summed(batch))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["moments"])

    parts = df.mapInArrow(run, "moments binary").rdd.map(lambda r: pickle.loads(r["moments"]))  # one small row a task
    return parts.treeReduce(merged, depth=2) if parts.getNumPartitions() else {}


def whole_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): the rows that have a usable vector, in whole numbers."""
    rows = take(df, key=key, vector=vector).withColumn("vector", F.col("vector").cast("array<double>"))
    usable = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return rows.where(F.col("vector").isNotNull() & usable).select("key", F.transform("vector", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


@dataclass
class Space:
    """The whitening of vectors of one length."""

    n: int
    sums: list[int]
    mean: np.ndarray
    directions: np.ndarray  # a column each component
    values: np.ndarray
    trace: float
    error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (x - self.mean) @ self.directions / np.sqrt(self.values), np.nan)


def fit(vectors: DataFrame, components: int = 4) -> dict[int, Space]:
    """The whitening of each length of ``vectors`` (x), checked on the fit list. What it keeps is of d * components numbers."""
    listed = stored(vectors.select("x").distinct(), "vectors")
    total = _merged_over(listed, lambda batch: {d: moments(x.astype(np.float64), x) for d, _, x in _matrices(batch.column("x"))})
    spaces = {}
    for d, m in total.items():
        values, directions = np.linalg.eigh(m.scatter / m.n)
        values, directions = values[::-1][:components].copy(), directions[:, ::-1][:, :components].copy()
        values[values <= max(values[0], 0) * d * np.finfo(float).eps * 8] = 0
        mean = np.array([s / m.n for s in m.sums], float)
        spaces[d] = Space(m.n, list(m.sums), mean, directions, values, float(np.trace(m.scatter) / m.n))
    sent = vectors.sparkSession.sparkContext.broadcast(spaces)

    def again(batch):
        made = {d: sent.value[d].whitened(x)[:, sent.value[d].values > 0] for d, _, x in _matrices(batch.column("x"))}
        return {d: moments(w) for d, w in made.items() if w.shape[1]}

    for d, m in _merged_over(listed, again).items():
        spaces[d].error = float(np.abs(m.scatter / m.n - np.eye(len(m.mean))).max())
    return spaces


def _deviation(x: np.ndarray, space: Space) -> list[int | None]:
    """Sum over dimensions of (n * x - sums) ** 2, exact; None where it needs more than 64 bits."""
    near = ((x.astype(np.float64) * space.n - np.array(space.sums, float)) ** 2).sum(axis=1)
    if near.max(initial=0) < 2.0**62 and space.n * max(float(np.abs(x).max(initial=0)), 1) < 2.0**62:
        return ((x * space.n - np.array(space.sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((space.n * int(v) - s) ** 2 for v, s in zip(row, space.sums, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(df: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each usable row and component."""
    rows = whole_vectors(df, key, vector)
    kind = rows.schema["key"].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(fit(rows, components))
    names = ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for batch in batches:
            for d, at, x in _matrices(batch.column("x")):
                space = sent.value[d]
                c = len(space.values)
                made = space.whitened(x).ravel()
                explained = [float(v / space.trace) if space.trace > 0 else None for v in space.values]
                columns = [
                    batch.column("key").take(pa.array(np.repeat(at, c))),
                    pa.array(np.tile(np.arange(1, c + 1), len(at)), pa.int32()),
                    pa.array(np.full(c * len(at), space.n), pa.int64()),
                    pa.array([v for v in _deviation(x, space) for _ in range(c)], pa.int64()),
                    pa.array(made, pa.float64(), mask=np.isnan(made)),
                    pa.array(explained * len(at), pa.float64()),
                    pa.array([space.error] * (c * len(at)), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    out = rows.mapInArrow(run, f"key {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("key", key)
