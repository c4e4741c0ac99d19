"""Whitening of embeddings: projections on the principal directions of whole-number vectors, scaled to unit variance.

Vectors are brought to whole numbers, x = floor(scale · c) + shift, whose sums are exact. The directions come from the rows themselves and not
from products of them: each task reduces its centred rows block by block to a triangle R by QR, triangles are reduced in rounds of a
bounded number at a time, and ``bidiagonal.right_vectors`` finds the singular values and directions of the last one on the driver, a
matrix as wide as the vectors. Whitened rows are written once; their covariance is added up from them and compared with the identity.

Defined results: rows whose vector is null or holds a null or non-finite entry, or one that leaves 62 bits when scaled, take no part; a
missing entry of a shorter vector is 0; each row has its own results, also where ids repeat or are null; ids may be of any type; there are
as many components as asked for, but only those with a variance beyond rounding (1e-20 of the largest): none for equal vectors or
a single one; a deviation beyond 63 bits is null; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.bidiagonal import right_vectors
from tallygrid.llm.textkit import stored

#: Least share of the largest variance that tells a direction from rounding.
LEAST_SHARE = 1e-20
BLOCK_ROWS = 2048
#: Bytes of partial results that one task or the driver puts together.
FOLD_BYTES = 64 << 20
SPLIT = 31


@dataclass(frozen=True)
class Whitening:
    """Exact sums and the directions of a fit list."""

    n: int
    sums: list[int]
    scale: int
    shift: int
    values: np.ndarray
    directions: np.ndarray
    total: float

    @property
    def dims(self) -> int:
        return len(self.sums)


def usable(vector: Column, scale: int) -> Column:
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * F.lit(float(scale))) < F.lit(float(1 << 62)))
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(fits(c), F.lit(False)))


def _whole(column: pa.Array, dims: int, scale: int, shift: int) -> np.ndarray:
    """x of some vectors, ``dims`` wide."""
    sizes = column.value_lengths().to_numpy()
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * scale).astype(np.int64) + shift
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.full((len(sizes), dims), shift, np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _sums(rows: DataFrame, scale: int, shift: int) -> tuple[int, list[int]]:
    """Number of rows, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            if not len(sizes):
                continue
            dims = int(sizes.max())
            x = _whole(batch.column(1), dims, scale, shift)
            x -= np.where(np.arange(dims) < sizes[:, None], 0, shift)
            columns = [np.arange(-1, dims), np.append(0, (x >> SPLIT).sum(0)), np.append(len(x), (x & ((1 << SPLIT) - 1)).sum(0)), np.append(0, (np.arange(dims) < sizes[:, None]).sum(0))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["dim", "high", "low", "known"])

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "known")]
    found = {r.dim: r for r in rows.mapInArrow(run, "dim long, high long, low long, known long").groupBy("dim").agg(*wide).collect()}
    n = int(found[-1].low) if found else 0
    dims = range(len(found) - 1) if found else ()
    return n, [(int(found[d].high) << SPLIT) + int(found[d].low) + (n - int(found[d].known)) * shift for d in dims]


class Centre:
    """Rows against their mean: exactly as n·x - S, or as doubles."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        near = [s // n for s in sums]
        self.near = np.array(near, np.int64)
        self.rest = np.array([s - n * m for s, m in zip(sums, near)], np.int64)

    def doubles(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(float) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        y = x - self.near
        far = (float(np.abs(y).max(initial=0)) + 1) * self.n
        if far * far * max(1, x.shape[1]) < 2.0**62:
            return ((y * self.n - self.rest) ** 2).sum(1).tolist()
        rest = self.rest.tolist()
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, rest)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def _folded(parts: DataFrame, combine: Callable[[bytes, bytes], bytes], size: int) -> bytes | None:
    """All blobs of (part, blob) put together, in rounds of as many as fit ``FOLD_BYTES``."""
    fan = max(2, min(64, FOLD_BYTES // max(1, size)))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        blobs = group.column("blob").to_pylist()
        whole = blobs[0]
        for more in blobs[1:]:
            whole = combine(whole, more)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([whole], pa.binary())})

    parts = stored(parts, "partial-results")
    while (count := parts.count()) > fan:
        groups = F.pmod(F.xxhash64("part"), F.lit(-(-count // fan)))
        parts = stored(parts.select(groups.alias("part"), "blob").groupBy("part").applyInArrow(run, "part long, blob binary"), "partial-results")
    whole = None
    for r in parts.orderBy("part").toLocalIterator():
        whole = bytes(r.blob) if whole is None else combine(whole, bytes(r.blob))
    return whole


def _part(blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([blob], pa.binary())], ["part", "blob"])


def _triangle(rows: DataFrame, n: int, sums: list[int], scale: int, shift: int) -> np.ndarray:
    """R of the centred rows."""
    dims = len(sums)

    def put(triangle: np.ndarray, block: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(np.concatenate([triangle, block]), "r")
        return np.concatenate([r, np.zeros((dims - len(r), dims))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, triangle = Centre(n, sums), np.zeros((dims, dims))
        any_row = False
        for batch in batches:
            x = _whole(batch.column(1), dims, scale, shift)
            any_row |= len(x) > 0
            for a in range(0, len(x), BLOCK_ROWS):
                triangle = put(triangle, centre.doubles(x[a : a + BLOCK_ROWS]))
        if any_row:
            yield _part(triangle.tobytes())

    shape = lambda b: np.frombuffer(b).reshape(dims, dims)
    whole = _folded(rows.mapInArrow(run, "part long, blob binary"), lambda a, b: put(shape(a), shape(b)).tobytes(), 8 * dims * dims)
    return shape(whole)


def fit(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, vector_col: str = "embedding") -> Whitening:
    """Directions and variances of all usable vectors."""
    rows = vectors.where(usable(F.col(vector_col), scale)).select(F.lit(0).alias("id"), F.col(vector_col).alias("v"))
    n, sums = _sums(rows, scale, shift)
    if not n or not sums:
        return Whitening(n, sums, scale, shift, np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    squares, directions = right_vectors(_triangle(rows, n, sums, scale, shift))
    kept = min(components, int((squares > LEAST_SHARE * squares[0]).sum()) if squares[0] > 0 else 0)
    return Whitening(n, sums, scale, shift, squares[:kept] / n, directions[:, :kept], float(squares.sum()) / n)


def transform(vectors: DataFrame, by: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, deviation, whitened) of each usable vector; ``whitened`` holds one number per component."""
    rows = vectors.where(usable(F.col(vector_col), by.scale)).select(id_col, F.col(vector_col).alias("v"))
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = Centre(by.n, by.sums)
        scaled = by.directions / np.sqrt(by.values)
        for batch in batches:
            x = _whole(batch.column(1), by.dims, by.scale, by.shift)
            out = centre.doubles(x) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centre.deviations(x), pa.int64()), lists], [id_col, "deviation", "whitened"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, size: int) -> float:
    """Largest entry, by amount, of the covariance of ``whitened`` minus the identity."""

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Moments as (n, means, products about the means), put together."""
        n = a[0] + b[0]
        apart = b[1 : size + 1] - a[1 : size + 1]
        products = a[size + 1 :] + b[size + 1 :] + (np.outer(apart, apart) * (a[0] * b[0] / n)).ravel()
        return np.concatenate([[n], a[1 : size + 1] + apart * (b[0] / n), products])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            w = batch.column(0).flatten().to_numpy().reshape(-1, size)
            if len(w):
                mean = w.mean(0)
                own = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])
                whole = own if whole is None else join(whole, own)
        if whole is not None:
            yield _part(whole.tobytes())

    blob = _folded(whitened.select("whitened").mapInArrow(run, "part long, blob binary"), lambda a, b: join(np.frombuffer(a), np.frombuffer(b)).tobytes(), 8 * (size + 1) ** 2)
    moments = np.frombuffer(blob)
    return float(np.abs(moments[size + 1 :].reshape(size, size) / moments[0] - np.eye(size)).max())


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    by = fit(vectors, components, scale, shift, vector_col)
    rows = transform(vectors, by, id_col, vector_col)
    size, error = len(by.values), None
    if size:
        rows = stored(rows, "whitened")
        error = identity_error(rows, size)
    shares = F.array(*[F.lit(float(v / by.total)) for v in by.values]) if size else F.array().cast("array<double>")
    long = rows.select(id_col, F.posexplode("whitened").alias("at", "value"), "deviation")
    return long.select(
        id_col, (F.col("at") + 1).alias("component"), F.lit(by.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"),
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
