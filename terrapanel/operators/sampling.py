"""Repeatable samples and exact slices of an ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.functions.scalars import present
from terrapanel.session import checkpointed
from terrapanel.operators.quantiles import count_values, order_statistics

_HASH_RANGE = 1 << 52  # exact as a double


def row_hash(keys: Sequence[str], seed: int = 42) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all) by smallest hash of a unique key.

    The sample is found as a hash threshold for every ``n``, so no task ever holds it and a
    smaller sample is part of a larger one.
    """
    if n <= 0:
        return df.limit(0)
    tagged = df.withColumn("_h", F.pmod(row_hash(keys, seed), F.lit(_HASH_RANGE)))
    total = count_values(tagged, ["_h"])["_h"]
    if total <= n:
        return df
    cut = int(order_statistics(tagged, {"_h": [n - 1]}, {"_h": total})["_h"][n - 1])
    below = tagged.filter(F.col("_h") < cut)
    missing = n - below.count()
    edge = tagged.filter(F.col("_h") == cut).orderBy(*keys).limit(missing)
    return below.unionByName(edge).drop("_h")


def sample_fraction(df: DataFrame, keys: Sequence[str], percent: int, seed: int = 42) -> DataFrame:
    """About ``percent`` of the rows, the same ones on every run."""
    return df.filter(F.pmod(row_hash(keys, seed), F.lit(100)) < percent)


def rank_slice(df: DataFrame, order: str, key: str, start: int, stop: int) -> DataFrame:
    """Rows at ascending 0-based places ``start``..``stop-1`` by (order, numeric key).

    Places are resolved by exact order statistics, so nothing is sorted as a whole.
    """
    n = count_values(df, [order])[order]
    start, stop = max(start, 0), min(stop, n)
    if start >= stop:
        return df.limit(0)
    ends = order_statistics(df, {order: [start, stop - 1]}, {order: n})[order]
    low, high = ends[start], ends[stop - 1]
    v = F.col(order).cast("double")
    less_low, less_high = df.agg(F.count_if(v < F.lit(low)), F.count_if(v < F.lit(high))).first()

    def tie_cut(value: float, place: int) -> int:
        """Key of the row at ``place`` among rows equal to ``value``."""
        return int(order_statistics(df.filter(v == F.lit(value)), {key: [place]})[key][place])

    first_key = tie_cut(low, start - less_low)
    last_key = tie_cut(high, stop - 1 - less_high)
    k = F.col(key)
    after = (v > F.lit(low)) | ((v == F.lit(low)) & (k >= F.lit(first_key)))
    before = (v < F.lit(high)) | ((v == F.lit(high)) & (k <= F.lit(last_key)))
    return df.filter(after & before)


def median_neighbours(df: DataFrame, order: str, key: str, width: int = 5) -> DataFrame:
    """The rows around place n/2 of the ordering."""
    n = count_values(df, [order])[order]
    start = n // 2 - width // 2
    return rank_slice(df, order, key, start, start + width)


def extreme_rows(df: DataFrame, order: str, key: str, k: int = 5, largest: bool = True) -> DataFrame:
    """The first rows of an ordering; missing values, NaN among them, take no part."""
    kept = df.filter(present(df, order))
    return kept.orderBy(F.desc(order) if largest else F.asc(order), F.asc(key)).limit(k)


def first_rows(df: DataFrame, keys: Sequence[str], n: int = 1000) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def forward_fill(df: DataFrame, order: str, columns: Sequence[str], chunk: int = 100_000) -> DataFrame:
    """Carry the last seen value forward along an integer line number.

    A prefix scan in levels: lines are cut into chunks, the chunks' last values into chunks of
    chunks, and so on up to a single one; each level takes in what the level above carries into its
    group. No window holds more than ``chunk`` places, and the driver sees the first and last line
    number. Lines without a number form a group of their own.
    """
    low, high = df.agg(F.min(order), F.max(order)).first()
    # Counted from the first line, so that numbers below zero end in one group too.
    lines = df.withColumn("_c1", F.floor((F.col(order) - F.lit(low)) / F.lit(chunk)))
    inside = W.partitionBy("_c1").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    filled = lines.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    last = {c: F.max(F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c) for c in columns}
    summaries = [lines.groupBy("_c1").agg(*last.values())]
    end, fan = (high - low) // chunk if low is not None else 0, max(chunk, 2)
    while end:
        level = len(summaries)
        below, group = summaries[-1], f"_c{level + 1}"
        summaries[-1] = checkpointed(below.withColumn(group, F.floor(F.col(f"_c{level}") / F.lit(fan))))
        # Of a level's last values the one of the greatest line is the last of the group.
        summaries.append(summaries[-1].groupBy(group).agg(*[F.max(c).alias(c) for c in columns]))
        end //= fan
    carried = None
    for level in range(len(summaries) - 1, 0, -1):
        here, group = f"_c{level}", f"_c{level + 1}"
        before = W.partitionBy(group).orderBy(here).rowsBetween(W.unboundedPreceding, -1)
        inner = summaries[level - 1].select(here, group, *[F.last(c, ignorenulls=True).over(before).alias(f"_in_{c}") for c in columns])
        if carried is not None:
            above = carried.select(group, *[F.col(f"_in_{c}").alias(f"_up_{c}") for c in columns])
            inner = inner.join(above, group, "left").select(here, *[F.coalesce(f"_in_{c}", f"_up_{c}").alias(f"_in_{c}") for c in columns])
        carried = checkpointed(inner.select(here, *[f"_in_{c}" for c in columns]))
    if carried is None:
        return filled.select(*df.columns)
    out = filled.join(carried, "_c1", "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"_in_{c}")[c]).alias(c) if c in columns else F.col(c) for c in df.columns])
