"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Sums, scatter and the check of the result are partial aggregates of partitions, added up by Spark;
only the dimension decides the size of what the driver gets: one sum per dimension, one cell per
pair of dimensions. There the centred scatter is factored as A A' with pivots, and Jacobi rotations
of A's columns make these orthogonal: their squared norms are the eigenvalues, their directions the
components. The scatter is never squared again, so small eigenvalues keep their relative precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components that are returned, at most.
COMPONENTS = 32
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Scaled entries beyond this have no long; their rows count as not finite.
LARGEST = float(1 << 62)
#: Rounds over all pairs of columns after which Jacobi gives up; about ten suffice.
SWEEPS = 60

Batches = Iterator[pa.RecordBatch]


def finite_rows(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """``(id_col, v)`` of the rows that have only finite entries and the commonest length, and that length (0: no rows)."""
    entries = F.col(vec_col).cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < LARGEST))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col), entries.alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = common["d"] if common else 0
    return rows.where(F.size("v") == d), d


def _longs(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The batch's vectors as whole numbers, a row each."""
    c = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(c * SCALE).astype(np.int64) + SHIFT


def _range_sums(d: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        n, sums, low, high = 0, np.zeros(d, object), None, None
        for batch in batches:
            if x := len(batch):
                longs = _longs(batch, d)
                lo, hi = longs.min(axis=0), longs.max(axis=0)
                small = max(-int(lo.min()), int(hi.max())) < (1 << 62) // x
                sums += (longs if small else longs.astype(object)).sum(axis=0).astype(object)
                low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
                n += x
        if n:
            totals = pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d), totals, pa.array(low), pa.array(high)], ["dim", "n", "s", "low", "high"])

    return run


class Centre:
    """Count and sums of the fit list; centres vectors exactly."""

    def __init__(self, n: int, sums: list[int], low: list[int], high: list[int]) -> None:
        self.n, self.sums, self.d = n, sums, len(sums)
        spread = n * max(h - lo for lo, h in zip(low, high, strict=True))
        reach = n * max(max(abs(lo), abs(h)) for lo, h in zip(low, high, strict=True))
        #: Whether all products and squares fit 64 bits; otherwise Python's integers take over.
        self.fits = reach < 1 << 61 and self.d * spread**2 < 1 << 62

    def deviations(self, longs: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        kind = np.int64 if self.fits else object
        return longs.astype(kind) * self.n - np.array(self.sums, kind)

    def centred(self, longs: np.ndarray) -> np.ndarray:
        return (self.deviations(longs) / self.n).astype(np.float64)


def centre_of(rows: DataFrame, d: int) -> Centre:
    schema = "dim int, n bigint, s decimal(38,0), low bigint, high bigint"
    sums = rows.mapInArrow(_range_sums(d), schema).groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    got = sums.orderBy("dim").collect()
    return Centre(got[0]["n"], [int(r["s"]) for r in got], [r["low"] for r in got], [r["high"] for r in got])


def _products(centre: Centre, transform: np.ndarray | None) -> Callable[[Batches], Batches]:
    """Sums of products of all pairs of columns, and below them (at -1 - i) the sums of the columns."""

    def run(batches: Batches) -> Batches:
        width = centre.d if transform is None else transform.shape[1]
        gram, total = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            z = centre.centred(_longs(batch, centre.d))
            z = z if transform is None else z @ transform
            gram += z.T @ z
            total += z.sum(axis=0)
        i, j = np.triu_indices(width)
        cells = np.concatenate([i * width + j, -1 - np.arange(width)])
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.concatenate([gram[i, j], total]))], ["cell", "x"])

    return run


def covariance(rows: DataFrame, centre: Centre, transform: np.ndarray | None = None) -> np.ndarray:
    """Covariance, divisor n, of the centred vectors, or of what ``transform`` makes of them."""
    width = centre.d if transform is None else transform.shape[1]
    got = rows.mapInArrow(_products(centre, transform), "cell bigint, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    cells = {r["cell"]: r["x"] for r in got}
    upper = np.array([[cells[i * width + j] if i <= j else 0.0 for j in range(width)] for i in range(width)])
    mean = np.array([cells[-1 - i] for i in range(width)]) / centre.n
    return (upper + np.triu(upper, 1).T) / centre.n - np.outer(mean, mean)


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """A, of as many columns as ``v`` has rank, with A A' = v; rows in the order of ``v``."""
    d = len(v)
    order, left, factor, rank = np.arange(d), v.diagonal().copy(), np.zeros((d, d)), 0
    least = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    while rank < d:
        pivot = rank + int(np.argmax(left[rank:]))
        if left[pivot] <= least:
            break
        for a in (order, left, factor):
            a[[rank, pivot]] = a[[pivot, rank]]
        top = np.sqrt(left[rank])
        below = (v[order[rank + 1 :], order[rank]] - factor[rank + 1 :, :rank] @ factor[rank, :rank]) / top
        factor[rank, rank], factor[rank + 1 :, rank] = top, below
        left[rank + 1 :] -= below**2
        rank += 1
    out = np.zeros((d, rank))
    out[order] = factor[:, :rank]
    return out


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of A A' in falling order and its unit eigenvectors as columns, by rotations of A's columns."""
    a = np.asfortranarray(factor)
    rank = a.shape[1]
    close = 4 * np.finfo(float).eps
    for _ in range(SWEEPS):
        turned = False
        for p in range(rank - 1):
            for q in range(p + 1, rank):
                x, y = a[:, p], a[:, q]
                xx, yy, xy = x @ x, y @ y, x @ y
                if abs(xy) <= close * np.sqrt(xx * yy):
                    continue
                turned = True
                zeta = (yy - xx) / (2 * xy)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    squares = (a * a).sum(axis=0)
    order = np.argsort(-squares, kind="stable")
    units = a[:, order] / np.sqrt(squares[order])
    largest = np.abs(units).argmax(axis=0) if rank else np.zeros(0, int)
    return squares[order], units * np.where(units[largest, np.arange(rank)] < 0, -1.0, 1.0)


def _whitened(centre: Centre, transform: np.ndarray, explained: np.ndarray, error: float, id_col: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        k = transform.shape[1]
        for batch in batches:
            rows = len(batch)
            exact = centre.deviations(_longs(batch, centre.d))
            squares = (exact * exact).sum(axis=1)
            squares = pa.array(np.repeat(squares, k)) if centre.fits else pa.array([int(s) if s < 1 << 63 else None for s in squares for _ in range(k)], pa.int64())
            white = ((exact / centre.n).astype(np.float64) @ transform).ravel()
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(rows), k)))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, centre.n)), squares]
            columns += [pa.array(white), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Coordinates of every vector on the first components of the covariance, scaled to variance 1.

    Returns ``(id_col, component, n, deviation, whitened, explained, identity_error)``, a row for each
    remaining vector and component. ``deviation`` is exact (null where it exceeds a long);
    ``identity_error`` is measured in a pass over the whitened rows.

    Vectors that are null or hold a null or non-finite entry, or one of 2^56 and more, are left out, as
    are vectors of another length than the commonest. Null and repeated ids give rows each, and count each. There are as
    many components as the covariance has rank, so equal vectors, or none, give an empty table; other
    columns are ignored.
    """
    rows, d = finite_rows(vectors, id_col, vec_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if d:
        centre = centre_of(rows, d)
        v = covariance(rows, centre)
        values, units = jacobi(pivoted_cholesky(v))
        values, units = values[:components], units[:, :components]
        if len(values):
            transform = units / np.sqrt(values)
            error = float(np.abs(covariance(rows, centre, transform) - np.eye(len(values))).max())
            return rows.mapInArrow(_whitened(centre, transform, values / np.trace(v), error, id_col), schema)
    return vectors.sparkSession.createDataFrame([], schema)
