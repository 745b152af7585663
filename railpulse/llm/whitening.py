"""Whitening of integer vectors by their leading principal components, found by Jacobi-Davidson.

The covariance is never formed. Vectors are stored once as blocks of rows; a pass
over the blocks gives the covariance times a few columns at a time, ``(1/n) sum d (d.u)``
with ``d = x - S/n``, and ``jacobi_davidson.largest`` does the rest with these products.

* Sums S are exact (integers); a row is centred by ``x - q - r/n`` with ``S = q n + r``
  before anything is multiplied.
* What a task has summed up leaves it as one row for each entry of the product, as a
  pair of integers on a fixed scale. Spark adds integers, so the order of tasks, retries
  and lost executors don't change a bit of the result, and the driver gets
  ``dims x columns`` rows however large the table is.
* No shuffle moves vectors, no key is grouped: nothing can be skewed.

Defined results: a vector takes part if it isn't null and has neither null nor
non-finite entries. Shorter vectors count as padded with ``pad`` (an empty one is all
``pad``); repeated rows and ids and null ids each give a row. Entries beyond
``+-LIMIT`` count as ``+-LIMIT``. A component whose value isn't above rounding (rank
deficit, equal rows, one row) isn't returned, so whitened may be an empty array. An empty
table gives no rows. Other columns of the input are not looked at. A deviation beyond a
long is null. With equal eigenvalues any orthonormal choice is right; ours is fixed by
the data and the seed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.llm.jacobi_davidson import EPS, largest
from railpulse.session import materialize

#: Largest magnitude of an integer entry.
LIMIT = 1 << 61
#: Entries of a stored block.
BLOCK_ENTRIES = 1 << 18
_HI, _LO = float(1 << 52), float(1 << 40)


@dataclass
class Model:
    """What whitening needs: the fit's size and exact sums, and falling eigenvalues with their unit vectors."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def finite(vector: str | Column) -> Column:
    """True for a vector that takes part."""
    v = F.col(vector) if isinstance(vector, str) else vector
    v = v.cast("array<double>")
    return v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def scaled(vector: str, scale: float, offset: int) -> Column:
    """floor(scale * c) + offset of every component, as long."""
    top = float(LIMIT >> 1)
    one = lambda c: F.floor(F.least(F.greatest(F.lit(scale) * c, F.lit(-top)), F.lit(top))) + F.lit(offset)
    return F.transform(F.col(vector).cast("array<double>"), one)


def _blocks(rows: DataFrame, dims: int, pad: int) -> DataFrame:
    """ids and data (int64 rows as bytes) of the rows (id, x), in blocks of bounded size."""
    size, wide = max(1, BLOCK_ENTRIES // max(dims, 1)), dims

    def pack(batches):
        for batch in batches:
            x = batch.column("x")
            lengths, flat = np.diff(x.offsets.to_numpy()), x.flatten().to_numpy()
            if len(lengths) and (lengths == wide).all():
                full = flat.reshape(len(lengths), wide)
            else:
                full = np.full((len(lengths), wide), pad, np.int64)
                full[np.arange(wide) < lengths[:, None]] = flat
            full = np.clip(full, -LIMIT, LIMIT)
            for k in range(0, len(full), size):
                ids = batch.column("id").slice(k, size)
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([len(ids)], pa.int32()),
                    pa.array([np.ascontiguousarray(full[k:k + size]).tobytes()], pa.binary())], names=["ids", "rows", "data"])

    return rows.mapInArrow(pack, f"ids array<{dict(rows.dtypes)['id']}>, rows int, data binary")


def _each(batches, dims: int):
    """Every block's rows as a matrix."""
    for batch in batches:
        for data in batch.column("data"):
            yield np.frombuffer(data.as_buffer(), np.int64).reshape(-1, dims)


def _centred(x: np.ndarray, quotient: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - quotient) - rest


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """S = q n + r by dimension: q as integers and r / n."""
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums], np.float64)


def _summed(blocks: DataFrame, part: Callable, shape: tuple[int, int], bound: float) -> np.ndarray:
    """The sum over all blocks of ``part(rows)``; ``bound``: what the sum of magnitudes of an entry can't pass."""
    dims = part.dims
    unit = 2.0 ** np.ceil(np.log2(bound))

    def task(batches):
        total, slip = np.zeros(shape), np.zeros(shape)
        for x in _each(batches, dims):
            more = part(x)
            new = total + more
            slip += np.where(np.abs(total) >= np.abs(more), (total - new) + more, (more - new) + total)
            total = new
        hi = np.rint(total / unit * _HI)
        lo = np.rint(((total - hi / _HI * unit) + slip) / unit * _HI * _LO)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(hi.ravel().astype(np.int64)), pa.array(lo.ravel().astype(np.int64))], names=["at", "hi", "lo"])

    got = blocks.select("data").mapInArrow(task, "at int, hi long, lo long").groupBy("at").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).toArrow()
    out = np.zeros(shape[0] * shape[1])
    at = got.column("at").to_numpy()
    out[at] = (got.column("hi").to_numpy().astype(float) + got.column("lo").to_numpy().astype(float) / _LO) / _HI * unit
    return out.reshape(shape)


class _Products:
    """sum of d (d.u) for the columns u of a matrix."""

    def __init__(self, dims, quotient, rest, columns):
        self.dims, self.q, self.r, self.columns = dims, quotient, rest, columns

    def __call__(self, x):
        d = _centred(x, self.q, self.r)
        return d.T @ (d @ self.columns)


class _Squares:
    """sum of d d by dimension."""

    def __init__(self, dims, quotient, rest):
        self.dims, self.q, self.r = dims, quotient, rest

    def __call__(self, x):
        d = _centred(x, self.q, self.r)
        return np.einsum("ij,ij->j", d, d)[:, None]


class _Outer:
    """sum of w w' of the whitened rows w."""

    def __init__(self, dims, quotient, rest, columns):
        self.dims, self.q, self.r, self.columns = dims, quotient, rest, columns

    def __call__(self, x):
        w = _centred(x, self.q, self.r) @ self.columns
        return w.T @ w


def _sums(blocks: DataFrame, dims: int) -> tuple[list[int], list[int], list[int]]:
    """Exact sums, least and largest entries by dimension; a sum goes as its low 31 bits and what lies above."""

    def task(batches):
        total, least, most = np.zeros((2, dims), object), np.full(dims, LIMIT, np.int64), np.full(dims, -LIMIT, np.int64)
        for x in _each(batches, dims):
            total += np.array([(x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)], object)
            least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), *(pa.array([int(v) for v in row], pa.int64()) for row in (*total, least, most))], names=["at", "hi", "lo", "least", "most"])

    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = blocks.select("data").mapInArrow(task, "at int, hi long, lo long, least long, most long")
    got = sorted(parts.groupBy("at").agg(big("hi"), big("lo"), F.min("least").alias("least"), F.max("most").alias("most")).collect())
    return [(int(r["hi"]) << 31) + int(r["lo"]) for r in got], [r["least"] for r in got], [r["most"] for r in got]


def fit(blocks: DataFrame, n: int, dims: int, components: int = 32, inner: int = 6) -> Model:
    """The leading components of the stored rows' covariance (divisor n)."""
    none = Model(n, [0] * dims, np.empty(0), np.empty((dims, 0)), 0.0, 0.0)
    if not dims or not n:
        return none
    sums, least, most = _sums(blocks, dims)
    none.sums = sums
    if least == most:
        return none
    q, r = _centre(n, sums)
    far = max(max(b - s // n, s // n - a) + 1 for s, a, b in zip(sums, least, most))
    reach = float(_summed(blocks, _Squares(dims, q, r), (dims, 1), 1.0 * n * far * far).sum())

    def product(columns: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(columns, axis=0)
        longest = float(norms.max(initial=0))
        if not longest:
            return np.zeros_like(columns)
        return _summed(blocks, _Products(dims, q, r, columns), columns.shape, 2 * reach * longest) / n

    values, vectors = largest(product, dims, components, inner=inner)
    real = values > 16 * dims * EPS * values.max(initial=0)
    values, vectors = values[real], vectors[:, real]
    k = len(values)
    spread = _summed(blocks, _Outer(dims, q, r, vectors / np.sqrt(values)), (k, k), 4.0 * n * k) / n if k else np.empty((0, 0))
    return Model(n, sums, values, vectors, reach / n, float(np.abs(spread - np.eye(k)).max(initial=0)))


def project(blocks: DataFrame, model: Model) -> DataFrame:
    """id, deviation (long, exact) and whitened (array<double>) of every stored row."""
    dims, n = len(model.sums), model.n
    q, r = _centre(n, model.sums) if n else (np.zeros(dims, np.int64), np.zeros(dims))
    whole = [s % n for s in model.sums] if n else []
    columns = model.vectors / np.sqrt(model.values)
    id_type = dict(blocks.dtypes)["ids"].removeprefix("array<")[:-1]

    def deviations(x):
        off = x - q
        reach = (int(np.abs(off).max(initial=0)) + 1) * n
        if dims * reach * reach < 1 << 63:
            d = n * off - np.array(whole, np.int64)
            return np.einsum("ij,ij->i", d, d).tolist()
        d = n * off.astype(object) - np.array(whole, object)
        return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]

    def task(batches):
        for batch in batches:
            for ids, data in zip(batch.column("ids"), batch.column("data")):
                x = np.frombuffer(data.as_buffer(), np.int64).reshape(len(ids), dims)
                w = _centred(x, q, r) @ columns
                k = w.shape[1]
                yield pa.RecordBatch.from_arrays([
                    ids.values, pa.array(deviations(x), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * k), pa.array(w.ravel()))], names=["id", "deviation", "whitened"])

    return blocks.select("ids", "data").mapInArrow(task, f"id {id_type}, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "x", components: int = 32, pad: int = 0) -> tuple[DataFrame, Model]:
    """Whitened rows (``vec_id``, deviation, whitened) of integer vectors, and the model they come from.

    ``vectors`` holds rows that take part only (see ``finite``); ``vector`` is an array of long.
    """
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<long>").alias("x"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, dims = size["n"], size["d"] or 0
    blocks = materialize(_blocks(rows, dims, pad), "whitening")
    model = fit(blocks, n, dims, components)
    return project(blocks, model).withColumnRenamed("id", vec_id), model
