"""Cross-product matrices over many columns in one distributed pass.

Each Arrow batch is reduced to a small matrix inside its task; each partition emits it as one
row, a fixed number of tasks add these up, and the driver receives so many matrices at most,
whatever the row count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that add up the vectors of all partitions.
GATHERS = 16


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Batch as rows x columns doubles with NULL as NaN."""
    cols = [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns]
    return np.column_stack(cols) if cols else np.empty((batch.num_rows, 0))


def sum_over_partitions(
    df: DataFrame, columns: Sequence[str], reduce_batch: Callable[[np.ndarray], np.ndarray], size: int
) -> np.ndarray:
    """Sum of ``reduce_batch(matrix)`` over all batches; the result has ``size`` numbers."""
    data = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    return sum_of_vectors(data, lambda batch: reduce_batch(_matrix(batch)), size)


def sum_of_vectors(
    df: DataFrame, reduce_batch: Callable[[pa.RecordBatch], np.ndarray], size: int, rebatch: Callable[[Iterator], Iterator] = iter
) -> np.ndarray:
    """Sum over all Arrow batches, or those ``rebatch`` makes of a partition's, of vectors of ``size`` numbers.

    A partition gives one row that holds its vector; ``GATHERS`` tasks add these up as they stream
    in, and the driver receives at most that many vectors.
    """

    def added(vectors) -> Iterator[pa.RecordBatch]:
        total = None
        for v in vectors:
            total = v if total is None else total + v
        if total is not None:
            row = [pa.array([int(TaskContext.get().partitionId()) % GATHERS], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, names=["gather", "v"])

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from added(np.asarray(reduce_batch(b), dtype=float).ravel() for b in rebatch(batches) if b.num_rows)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from added(np.frombuffer(x.as_py(), "<f8") for b in batches for x in b.column(1))

    parts = df.mapInArrow(partition, "gather int, v binary").repartition(GATHERS, "gather").mapInArrow(gather, "gather int, v binary")
    return sum((np.frombuffer(r["v"], "<f8") for r in parts.collect()), np.zeros(size))


def column_means(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return np.array([0.0 if v is None else v for v in row])


def gram(df: DataFrame, columns: Sequence[str], shift: np.ndarray | None = None) -> np.ndarray:
    """Z'Z with Z = [1, columns - shift]; rows holding a missing value must be gone."""
    k = len(columns) + 1
    offset = np.zeros(len(columns)) if shift is None else np.asarray(shift)

    def batch(m: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(m)), m - offset])
        return z.T @ z

    return sum_over_partitions(df, columns, batch, k * k).reshape(k, k)


def pairwise_correlation(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pearson r and row count of every pair, each over rows where both are present.

    Values are centred on their overall mean first, so sums of squares do not cancel.
    """
    k = len(columns)
    shift = column_means(df, columns)

    def batch(m: np.ndarray) -> np.ndarray:
        x = m - shift
        seen = ~np.isnan(x)
        x = np.where(seen, x, 0.0)
        mask = seen.astype(float)
        return np.stack([mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x])

    n, s, ss, xy = sum_over_partitions(df, columns, batch, 4 * k * k).reshape(4, k, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = xy - s * s.T / n
        vx, vy = ss - s * s / n, ss.T - s.T * s.T / n
        # a column that is constant but for rounding has no correlation
        tiny = 1e-20 * n * (shift**2)[:, None]
        varies = (vx > 1e-12 * ss) & (ss > tiny)
        r = np.where(varies & varies.T, cov / np.sqrt(vx * vy), np.nan)
    r = np.clip(r, -1.0, 1.0)
    np.fill_diagonal(r, np.where(np.isnan(np.diag(r)), np.nan, 1.0))
    return r, n
