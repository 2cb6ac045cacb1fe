"""Whitening of embeddings by two passes over their distinct whole-number vectors.

The first pass adds up the vectors exactly, as whole numbers of any size, which gives the mean. The second takes it from
every vector and sums outer products, one NumPy matrix product a batch. Each task leaves one matrix; ``treeAggregate``
merges them, so the driver gets few of them. It solves the symmetric eigenproblem by LAPACK; the projection, a matrix of
dimension x components, goes to the tasks with the function. Only matrices of that size leave the tasks, whatever the
number of vectors.

Copies of a vector meet once in the fit list: they are joined within each task before they are shuffled.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modsplit_spark.sources.workspace import materialize

#: Steps of one unit of an entry.
GRID = 256
COMPONENTS = 4
#: Vectors of one matrix product.
ROWS = 4096
#: Partial matrices that one task or the driver merges.
FAN_IN = 32


def grid(values: np.ndarray) -> np.ndarray:
    """floor(GRID * value) as 64-bit whole numbers; what lies outside their range becomes its nearest end."""
    scaled = np.floor(values.astype(np.float64) * GRID)
    inside = np.abs(scaled) < 2.0**63
    out = np.where(inside, scaled, 0).astype(np.int64)
    return out if inside.all() else np.where(inside, out, np.where(scaled > 0, np.int64(2**63 - 1), np.int64(-(2**63))))


def _vectors(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector of finite entries, and those as a matrix on the grid."""
    column = batch.column(name)
    lengths = pc.list_value_length(column).fill_null(0).to_numpy()
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(batch.num_rows), lengths)
    bad = np.bincount(owner, weights=~np.isfinite(values), minlength=batch.num_rows) > 0
    kept = pc.is_valid(column).to_numpy(zero_copy_only=False) & ~bad
    sizes = np.unique(lengths[kept])
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes[:5].tolist()}")
    return kept, grid(values[kept[owner]].reshape(int(kept.sum()), int(sizes[0]) if len(sizes) else 0))


def _to_grid(batches, name: str):
    for batch in batches:
        _, x = _vectors(batch, name)
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())], ["x"])


def fit_list(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Each distinct vector once, as little-endian 64-bit whole numbers: ``(x binary)``."""
    return rows.select(column).mapInArrow(partial(_to_grid, name=column), "x binary").distinct()


def _matrices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.column(0).slice(at, ROWS).to_pylist()
            if len({len(b) for b in some}) > 1:
                raise ValueError("vectors of different lengths")
            yield np.frombuffer(b"".join(some), "<i8").reshape(len(some), -1)


def _one(value) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(value)], pa.binary())], ["part"])


def _sums(batches):
    """Count, exact sums and largest size of an entry, as Python numbers."""
    n, sums, most = 0, None, 0
    for x in _matrices(batches):
        # The halves of an entry add up without overflow in a batch.
        high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
        here = [(int(h) << 32) + int(k) for h, k in zip(high, low, strict=True)]
        most = max(most, abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        n, sums = n + len(x), here if sums is None else _add(sums, here)
    if n:
        yield _one((n, sums, most))


def _add(a: list[int], b: list[int]) -> list[int]:
    if len(a) != len(b):
        raise ValueError(f"vectors of different lengths: {len(a)} and {len(b)}")
    return [x + y for x, y in zip(a, b, strict=True)]


def _add_sums(a, b):
    return b if a is None else a if b is None else (a[0] + b[0], _add(a[1], b[1]), max(a[2], b[2]))


def _outer(batches, mean: np.ndarray, basis: np.ndarray | None):
    """Count, sum and sum of outer products about it of centred (and projected) vectors, the last centred again on their own mean."""
    total = None
    for x in _matrices(batches):
        y = x - mean
        y = y if basis is None else y @ basis
        own = y.mean(0)
        total = _add_outer(total, (len(y), own, (y - own).T @ (y - own)))
    if total is not None:
        yield _one(total)


def _add_outer(a, b):
    """Merged sums of outer products about the mean of all."""
    if a is None or b is None:
        return b if a is None else a
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _merged(parts: DataFrame, add):
    """All tasks' parts as one, merged in tasks as long as there are many."""
    rdd = parts.rdd.map(lambda r: pickle.loads(r[0]))
    depth, left = 1, parts.rdd.getNumPartitions()
    while left > FAN_IN:
        depth, left = depth + 1, -(-left // FAN_IN)
    return rdd.treeAggregate(None, add, add, depth)


@dataclass
class Whitening:
    """A fitted projection. ``basis`` holds a unit eigenvector over the root of its eigenvalue in each column, by
    falling eigenvalue; components without variance are missing there (``len(values)`` counts them too)."""

    n: int
    sums: list[int]
    most: int
    values: np.ndarray
    trace: float
    basis: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact."""
        if len(self.sums) * (self.n * self.most + max(map(abs, self.sums), default=0)) ** 2 < 2**63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fit on each distinct vector once; None if there is no vector. Vectors must have one length, else ValueError."""
    vectors = materialize(fit_list(rows, column), "vectors")
    found = _merged(vectors.mapInArrow(_sums, "part binary"), _add_sums)
    if found is None:
        return None
    n, sums, most = found
    mean = np.array([s / n for s in sums])
    _, _, outer = _merged(vectors.mapInArrow(partial(_outer, mean=mean, basis=None), "part binary"), _add_outer)
    covariance = outer / n
    values, bases = np.linalg.eigh((covariance + covariance.T) / 2)
    values, bases = values[::-1][:components], bases[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    some = values > max(len(sums), 1) * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)
    basis = bases[:, some] / np.sqrt(values[some])
    error = 0.0
    if basis.shape[1]:
        _, _, white = _merged(vectors.mapInArrow(partial(_outer, mean=mean, basis=basis), "part binary"), _add_outer)
        error = float(np.abs(white / n - np.eye(basis.shape[1])).max())
    return Whitening(n, sums, most, np.maximum(values, 0.0), trace, basis, error)


def _transform(batches, name: str, fitted: Whitening):
    mean, width = fitted.mean, fitted.basis.shape[1]
    for batch in batches:
        kept, x = _vectors(batch, name)
        if not len(x):
            continue
        if x.shape[1] != len(fitted.sums):
            raise ValueError(f"vectors of different lengths: {x.shape[1]} and {len(fitted.sums)}")
        white = np.full((len(x), len(fitted.values)), np.nan)
        white[:, :width] = (x - mean) @ fitted.basis
        flat = pa.array(white.ravel(), from_pandas=True)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), flat)
        deviation = pa.array([str(d) for d in fitted.deviation(x)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), deviation, lists], [batch.schema.names[0], "deviation", "whitened"])


def transform(rows: DataFrame, fitted: Whitening, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(key, deviation string of a whole number, whitened array<double>)`` of every row with a vector of finite entries.

    A component without variance (fewer distinct vectors than components, say) has null there."""
    fields = [rows.schema[key], T.StructField("deviation", T.StringType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    return rows.select(key, column).mapInArrow(partial(_transform, name=column, fitted=fitted), T.StructType(fields))


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """The digest of ``op11``: ``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    Rows whose vector is null or holds null or non-finite entries are dropped; a table without vectors gives no row.
    Repeated rows and rows with null or repeated ids are returned as often as they stand there; copies of a vector count once in
    the fit. Vectors of fewer dimensions have fewer components; an empty vector has none. A component without variance has null
    ``whitened`` and is left out of ``identity_error``. A deviation over 64 bits raises an overflow error here, while ``transform``
    has it whole. Vectors of different lengths raise ValueError. Entries beyond 2^55 count as the nearest end of 64 bits. Other
    columns are not read.
    """
    fields = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(rows, "embedding", components)
    if fitted is None:
        return rows.select("vec_id").limit(0).select("vec_id", *(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in fields.split(", ")))
    explained = F.array(*(F.lit(float(v) / fitted.trace if fitted.trace > 0 else 0.0) for v in fitted.values)).cast("array<double>")
    one = transform(rows, fitted).select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    return one.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(fitted.identity_error).alias("identity_error"),
    )
