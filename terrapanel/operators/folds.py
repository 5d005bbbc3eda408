"""Fold columns for cross-validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.quantiles import count_values, order_statistics


def hashed_folds(df: DataFrame, keys: Sequence[str], k: int = 5, seed: int = 42, output: str = "fold") -> DataFrame:
    """Fold by row key: repeatable, and balanced in expectation."""
    h = F.xxhash64(*[F.col(c) for c in keys], F.lit(seed))
    return df.withColumn(output, F.pmod(h, F.lit(k)).cast("int"))


def entity_folds(
    df: DataFrame, entity: str, k: int = 5, seed: int = 42, nulls: str = "drop", output: str = "fold"
) -> DataFrame:
    """All rows of an entity in one fold. Rows without one are dropped or form their own block."""
    if nulls == "drop":
        df = df.filter(F.col(entity).isNotNull())
    elif nulls != "block":
        raise ValueError("nulls is 'drop' or 'block'")
    h = F.xxhash64(F.coalesce(F.col(entity).cast("string"), F.lit("")), F.lit(seed))
    return df.withColumn(output, F.pmod(h, F.lit(k)).cast("int"))


def contiguous_folds(df: DataFrame, order: str, k: int = 5, output: str = "fold") -> DataFrame:
    """Unshuffled blocks of near-equal size along a unique numeric order.

    Only the k-1 border values are looked up; nothing is sorted.
    """
    n = count_values(df, [order])[order]
    starts, at = [], 0
    for i in range(k - 1):
        at += n // k + (1 if i < n % k else 0)
        starts.append(at)
    found = order_statistics(df, {order: [s for s in starts if s < n]}, {order: n})[order]
    borders = [found[s] for s in starts if s in found]
    fold = F.lit(0)
    for b in borders:
        fold = fold + (F.col(order).cast("double") >= F.lit(b)).cast("int")
    return df.withColumn(output, fold)
