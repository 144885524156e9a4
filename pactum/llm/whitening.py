"""Whitening of embeddings by principal components.

Each partition computes count, mean and centred scatter of its vectors; partial results are merged pairwise, by Chan's formula, in
a tree over the executors. The driver gets one matrix, whose eigenvectors are the components. A second pass over all vectors
takes the covariance of what was whitened in the same way, and holds it against the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from pyspark.sql.types import IntegerType

from .common import session

#: Fixed by the contract: a vector's entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components that are returned, at most.
COMPONENTS = 32
#: Entries up to this have an exact long; vectors with larger ones are left out.
LARGEST = 2.0**46
#: Of the largest eigenvalue: what is below this share comes from rounding, and isn't a component.
NOTHING = 1e-12
#: Levels of the tree that partial results are merged in.
DEPTH = 3
_LONG = (1 << 63) - 1

Moments = tuple[int, np.ndarray, np.ndarray]  # count, mean, scatter about the mean


def moments(x: np.ndarray) -> Moments:
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    y = x - mean
    return len(x), mean, y.T @ y


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's pairwise merge."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def longs(column: pa.Array, size: int) -> np.ndarray:
    """x of a batch of vectors that `usable` let through."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def usable(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """vec_id and vector (doubles) of the rows that take part, and the length of their vectors."""
    v = rows[vector_col].cast(ArrayType(DoubleType()))
    fine = F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) <= LARGEST))  # not so for NaN, which is above all numbers
    rows = rows.select(rows[id_col].alias("vec_id"), v.alias("vector")).filter(fine & (F.size("vector") > 0))
    common = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = common["size"] if common else 0
    return rows.filter(F.size("vector") == size), size


def gathered(rows: DataFrame, size: int, fn) -> tuple[Moments, list[int]]:
    """Moments of fn(x) over all rows, and the exact sums of x."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = None, [0] * size
        for batch in batches:
            x = longs(batch.column(0), size)
            own = moments(fn(x))
            total = own if total is None else merged(total, own)
            sums = [a + b for a, b in zip(sums, x.sum(0).tolist(), strict=True)]
        if total and total[0]:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]], pa.int64()), *(pa.array([z.astype("<f8").tobytes()], pa.binary()) for z in total[1:]), pa.array([sums], pa.list_(pa.int64()))], names=["n", "mean", "scatter", "sums"])

    def unpacked(r) -> tuple[Moments, list[int]]:
        mean = np.frombuffer(r.mean, "<f8")
        return (r.n, mean, np.frombuffer(r.scatter, "<f8").reshape(len(mean), -1)), list(r.sums)

    def both(a, b):
        return merged(a[0], b[0]), [x + y for x, y in zip(a[1], b[1], strict=True)]

    k = fn(np.zeros((0, size), np.int64)).shape[1]
    none = ((0, np.zeros(k), np.zeros((k, k))), [0] * size)
    found = rows.select("vector").mapInArrow(partial, "n long, mean binary, scatter binary, sums array<long>").rdd.map(unpacked)
    return found.union(rows.sparkSession.sparkContext.parallelize([none], 1)).treeReduce(both, DEPTH)


@dataclass(frozen=True)
class Whitening:
    """What is fitted: n vectors with sums S, the components (rows, unit length) with their eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact: long, or objects where a long might not hold it."""
        s = np.array(self.sums, object)
        if self.n * int(np.abs(x).max(initial=0)) < _LONG // 2 and max(map(abs, self.sums), default=0) < _LONG // 2:
            return self.n * x - s.astype(np.int64)
        return self.n * x.astype(object) - s

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of squares of n*x - S, exact; None where a long can't hold it."""
        y = self.centred(x)
        if y.dtype == object or y.shape[1] * int(np.abs(y).max(initial=0)) ** 2 > _LONG:
            return [d if d <= _LONG else None for d in (y.astype(object) ** 2).sum(1).tolist()]
        return (y * y).sum(1).tolist()

    def whitened(self, x: np.ndarray) -> np.ndarray:
        y = self.centred(x).astype(float) / max(self.n, 1)
        return y @ self.components.T / np.sqrt(self.values)


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """rows: see `usable`. Components by falling eigenvalue, each with its largest entry positive; those without variance are left out."""
    (n, _, scatter), sums = gathered(rows, size, lambda x: x.astype(float))
    cov = scatter / max(n, 1)
    values, vectors = np.linalg.eigh(cov) if size else (np.zeros(0), np.zeros((0, 0)))
    values, vectors = values[::-1], vectors[:, ::-1].T
    keep = np.flatnonzero(values > NOTHING * max(values.max(initial=0), 0))[:components]
    own = vectors[keep]
    largest = np.take_along_axis(own, np.abs(own).argmax(1)[:, None], 1) if len(own) else np.ones((0, 1))
    return Whitening(n, sums, values[keep], own * np.sign(largest), float(np.trace(cov)))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null or empty or hold a null, non-finite or too large entry (above LARGEST) take no part. Where lengths
    differ, the commonest one counts (of ties the longest) and the others take no part. Directions without variance are no
    components, so one vector, or equal ones, give no rows; an empty table gives none. Null and repeated ids keep their rows.
    deviation is null where a long can't hold it. Other columns are not read. Nothing is shuffled but one matrix a partition.
    """
    session(rows)
    rows, size = usable(rows, id_col, vector_col)
    model = fit(rows, size, components)
    k = len(model.values)
    error = 0.0
    if k:
        (n, _, scatter), _ = gathered(rows, size, model.whitened)
        error = float(np.abs(scatter / n - np.eye(k)).max())
    shares = model.values / model.trace if k else np.zeros(0)
    id_type = rows.schema["vec_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            x = longs(batch.column(1), size)
            at = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(at), model.n, np.int64)),
                    pa.array(model.deviation(x), pa.int64()).take(pa.array(at)),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(shares, len(x))),
                    pa.array(np.full(len(at), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kinds = {"component": IntegerType(), "n": LongType(), "deviation": LongType(), "whitened": DoubleType(), "explained": DoubleType(), "identity_error": DoubleType()}
    return rows.mapInArrow(run, StructType([StructField("vec_id", id_type), *(StructField(c, t) for c, t in kinds.items())]))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
