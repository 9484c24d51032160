"""Embedding whitening by a bidiagonal qd solver.

Vectors lie on a grid of whole numbers. The *fit list* is each distinct vector once:
n vectors with sums S a dimension, both exact. Whitening projects ``x - S/n`` on the
unit eigenvectors of the fit list's covariance and divides by the roots of the
eigenvalues. The covariance is never formed to find them: that would square the
condition of the data.

1. Blockwise QR. Each task reduces the centred rows it reads, block by block, to one
   triangle; triangles are reduced by Spark in groups of ``FAN``, level by level, to one.
2. ``qd.right_vectors`` brings that triangle to bidiagonal form by Householder
   reflections, finds its singular values by dqds, and the directions by twisted
   factorisations. An eigenvalue is a squared singular value over n.

Only n, S, the triangle (width x width) and the directions meet the driver: their
size follows the width of a vector, never the rows. Distinct vectors are found by
a hash aggregate, which combines equal ones in each task, so a vector that a third
of all rows share costs one row a task. A last pass over the fit list measures how
far the whitened covariance is from the identity.

Cases: rows with a null vector, or a null, NaN or infinite component, are dropped.
Shorter vectors are filled with zeros. Components from 2^40 / 256 up raise an error.
There are ``min(components, width)`` components. Where the fit list does not vary
along a component (one distinct vector, or fewer than components), ``whitened`` is
null, ``explained`` 0 (or what rounding leaves of it), and the component does not
count in ``identity_error``. ``deviation`` is null where it exceeds a long. Rows that
share an id, or have a null one, get rows of their own. The sign of a component is
that its largest entry is positive. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import blocks as B
from lectern.llm import grids as G
from lectern.llm import qd
from lectern.session import dropped, kept

SCALE = 256
LIMIT = 1 << 40
FAN = 8
_LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """n, S, all eigenvalues (falling), and the directions of the leading ones as columns."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    directions: np.ndarray

    @property
    def varied(self) -> np.ndarray:
        """Which components vary beyond the rounding of the triangle."""
        k = self.directions.shape[1]
        least = (len(self.values) * qd.EPS) ** 2 * (self.values[0] if len(self.values) else 0.0)
        return self.values[:k] > least

    @property
    def explained(self) -> np.ndarray:
        total = float(self.values.sum())
        k = self.directions.shape[1]
        return self.values[:k] / total if total else np.zeros(k)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of each row; NaN where the component does not vary."""
        with np.errstate(divide="ignore"):
            scale = np.where(self.varied, 1.0 / np.sqrt(self.values[: self.directions.shape[1]]), np.nan)
        return (self.centred(x) @ self.directions) * scale


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - S/n``: exact up to the division, where the product fits a long."""
    if _fits(x, n):
        return (x * n - sums) / n
    return x - sums / n


def _fits(x: np.ndarray, n: int) -> bool:
    return 4 * n * (int(np.abs(x).max(initial=0)) + 1) < _LONG


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of ``(n x - S)^2`` by whole numbers."""
    if _fits(x, n):
        step = x * n - sums
        most = int(np.abs(step).max(initial=0))
        if most * most * x.shape[1] <= _LONG:
            return (step * step).sum(axis=1).tolist()
    found = []
    for row in x.tolist():
        total = sum((n * v - s) ** 2 for v, s in zip(row, sums.tolist()))
        found.append(total if total <= _LONG else None)
    return found


def _sums(fit: DataFrame, width: int) -> tuple[int, np.ndarray]:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = G.matrix(batch.column("x"), width)
                yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.sum(axis=0)], pa.list_(pa.int64()))], ["n", "total"])

    each = fit.mapInArrow(run, "n long, total array<long>").select("n", F.posexplode("total").alias("at", "value"))
    found = each.groupBy("at").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).orderBy("at").toArrow()
    return (found.column("n")[0].as_py(), found.column("value").to_numpy()) if found.num_rows else (0, np.zeros(width, np.int64))


def _triangle(rows: np.ndarray, width: int) -> np.ndarray:
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r


TRIANGLE = "part int, r binary"


def _triangles(fit: DataFrame, width: int, n: int, sums: np.ndarray) -> DataFrame:
    """One triangle a task, of the centred rows it reads."""

    def run(batches):
        r = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                r = _triangle(np.vstack([r, _centred(G.matrix(batch.column("x"), width), n, sums)]), width)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    return fit.mapInArrow(run, TRIANGLE)


def _one_triangle(parts: DataFrame, width: int) -> np.ndarray:
    """Triangles reduced in groups of ``FAN`` until one is left."""

    def run(key, table):
        rows = np.vstack([np.frombuffer(v.as_buffer(), np.float64).reshape(width, width) for v in table.sort_by("part").column("r")])
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([_triangle(rows, width).tobytes()], pa.binary())], names=["part", "r"])

    left = parts.agg(F.coalesce(F.max("part"), F.lit(-1))).first()[0] + 1
    while left > 1:
        left = -(-left // FAN)
        parts = parts.withColumn("to", F.pmod("part", F.lit(left))).groupBy("to").applyInArrow(run, TRIANGLE)
    found = parts.select("r").toArrow()
    return np.frombuffer(found.column("r")[0].as_buffer(), np.float64).reshape(width, width)


def fit(points: DataFrame, width: int, components: int) -> tuple[DataFrame | None, Whitening | None]:
    """The fit list, kept as a table, and its whitening, for points with ``x``."""
    distinct = kept(points.select("x").distinct(), "whitening-fit")
    n, sums = _sums(B.modest(distinct), width)
    if not n:
        return None, None
    triangles = kept(_triangles(distinct, width, n, sums), "whitening-triangles")
    values, directions = qd.right_vectors(_one_triangle(triangles, width), min(components, width))
    dropped(triangles)
    return distinct, Whitening(n, sums, values / n, directions)


def identity_error(distinct: DataFrame, own: Whitening, width: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    used = np.flatnonzero(own.varied)
    k = len(used)
    if not k:
        return 0.0
    shared = distinct.sparkSession.sparkContext.broadcast(own)

    def run(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = shared.value.of(G.matrix(batch.column("x"), width))[:, used]
            first += z.sum(axis=0)
            second += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([first, second.ravel()])], pa.list_(pa.float64()))], ["total"])

    each = distinct.mapInArrow(run, "total array<double>").select(F.posexplode("total").alias("at", "value"))
    total = each.groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").toArrow().column("value").to_numpy()
    mean, second = total[:k] / own.n, total[k:].reshape(k, k) / own.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, vector: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each kept row and component."""
    points, width = G.on_grid(table, vector, ["vec_id"], SCALE, LIMIT)
    points = B.modest(kept(points, "whitening-points"))
    distinct, own = fit(points, width, components)
    if own is None:
        return table.sparkSession.createDataFrame([], WHITENED)
    error = identity_error(distinct, own, width)
    dropped(distinct)
    shared = table.sparkSession.sparkContext.broadcast(own)

    def run(batches):
        white = shared.value
        k = white.directions.shape[1]
        for batch in batches:
            x = G.matrix(batch.column("x"), width)
            n, found = len(x), white.of(x)
            again = np.repeat(np.arange(n), k)
            deviation = pa.array(_deviations(x, white.n, white.sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").cast(pa.int64()).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, white.n, np.int64)), deviation.take(pa.array(again)),
                    pa.array(found.ravel(), from_pandas=True), pa.array(np.tile(white.explained, n)), pa.array(np.full(n * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return points.mapInArrow(run, WHITENED)
