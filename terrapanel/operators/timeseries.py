"""Hourly series to daily maxima, monthly bin counts and complete years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.bins import TEMPERATURE_BINS, Bin, bin_counts
from terrapanel.functions.scalars import columns_matching, row_entropy, row_sum, shift_hours


def local_daily_max(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: Column,
    hours: int = 8,
    strict_month: bool = False,
    name: str = "daily_max",
) -> DataFrame:
    """Daily maximum per key in local time.

    On one continuous table a local day always has its full set of hours. The flag
    ``strict_month`` instead drops hours whose local month differs from their UTC month,
    as happens when every month is a closed file of its own.
    """
    local = shift_hours(F.col(ts), hours)
    if strict_month:
        df = df.filter(F.trunc(local, "month") == F.trunc(F.col(ts), "month"))
    return df.groupBy(*keys, F.to_date(local).alias("day")).agg(F.max(value).alias(name))


def monthly_bin_counts(
    daily: DataFrame,
    keys: Sequence[str],
    value: str = "daily_max",
    bins: Sequence[Bin] = TEMPERATURE_BINS,
    prefix: str = "days_in_",
) -> DataFrame:
    """Number of days per bin for each key and month, all bins in one aggregation."""
    return daily.groupBy(
        *keys, F.year("day").alias("year"), F.month("day").alias("month")
    ).agg(*bin_counts(F.col(value), bins, prefix))


# Which day-count columns form each aggregate, by name fragment.
COLD = ("below_neg10", "neg10_neg5", "neg5_0")
HOT = ("30_35", "35_40", "40_plus")
MODERATE = ("15_20", "20_25", "25_30")
SHARE_GUARD = 1e-6


def temperature_aggregates(df: DataFrame) -> DataFrame:
    """Total, cold, hot and moderate days with their shares, and the spread over bins."""
    days = columns_matching(df, contains=("days_in_bin_",), without=("_x_canopy",))
    if not days:
        return df
    total = row_sum(days)
    out = {"total_days": total}
    for name, parts in (("extreme_cold", COLD), ("extreme_hot", HOT), ("moderate_temp", MODERATE)):
        family = [c for c in days if any(p in c for p in parts)]
        if family:
            out[f"{name}_days"] = row_sum(family)
            out[f"{name}_share"] = row_sum(family) / (total + F.lit(SHARE_GUARD))
    out["temperature_entropy"] = row_entropy(days, total, SHARE_GUARD)
    return df.withColumns(out)


# The broader indicators used by the simplified regressions.
INDICATORS = {
    "extreme_heat": ("bin_30_35", "bin_35_40", "bin_40_plus"),
    "high_temp": ("bin_25_30", "bin_30_35", "bin_35_40", "bin_40_plus"),
    "moderate_temp": ("bin_15_20", "bin_20_25"),
    "cold": ("bin_below_neg10", "bin_neg10_neg5", "bin_neg5_0", "bin_0_5"),
}


def temperature_indicators(df: DataFrame) -> DataFrame:
    """Heat, high, moderate and cold day totals and their canopy products."""
    out: dict[str, Column] = {}
    for name, parts in INDICATORS.items():
        plain = sum((F.col(f"days_in_{p}") for p in parts[1:]), F.col(f"days_in_{parts[0]}"))
        crossed = sum(
            (F.col(f"days_in_{p}_x_canopy") for p in parts[1:]), F.col(f"days_in_{parts[0]}_x_canopy")
        )
        out[f"{name}_days"] = plain
        out["cold_days_x_canopy" if name == "cold" else f"{name}_x_canopy"] = crossed
    return df.withColumns(out)


def humidity_heat_products(df: DataFrame, threshold: float = 70.0) -> DataFrame:
    """High-humidity flag and its products with hot days and canopy."""
    flag = F.when(F.col("rhu") >= threshold, 1).otherwise(0)
    return df.withColumns(
        {
            "high_humidity": flag,
            "high_temp_high_humid": F.col("high_temp_days") * flag,
            "canopy_high_temp_humid": F.col("canopy_share") * F.col("high_temp_days") * flag,
        }
    )


def complete_years(monthly: Sequence[DataFrame], ts: str) -> DataFrame:
    """Union monthly cubes and keep the years in which all twelve months are present."""
    cube = monthly[0]
    for part in monthly[1:]:
        cube = cube.unionByName(part)
    return keep_complete_years(cube, ts)


def keep_complete_years(cube: DataFrame, ts: str) -> DataFrame:
    with_year = cube.withColumn("year", F.year(ts))
    full = (
        with_year.groupBy("year")
        .agg(F.count_distinct(F.month(ts)).alias("months"))
        .filter(F.col("months") == 12)
        .select("year")
    )
    return with_year.join(full, "year", "left_semi")
