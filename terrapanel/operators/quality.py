"""Checks on source tables, reported as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.scalars import hours_in_year
from terrapanel.operators.profile import missing_profile, range_profile, structure_report

CHECK_SCHEMA = "check string, passed boolean, message string"

# Tolerances of the established checks.
EXTENT_TOLERANCE = 1.0
MIN_HOUR_SHARE = 0.95
MAX_NULL_PERCENT = 5.0
KELVIN_RANGE = (200.0, 350.0)


def required_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    message = f"missing: {', '.join(missing)}" if missing else "all required columns present"
    return df.sparkSession.createDataFrame([("required_columns", not missing, message)], CHECK_SCHEMA)


def extent_check(
    df: DataFrame, bounds: dict[str, float], lon: str = "lon", lat: str = "lat", tolerance: float = EXTENT_TOLERANCE
) -> DataFrame:
    """Each edge of the data's bounding box against the expected one."""
    edges = {"south": F.min(lat), "north": F.max(lat), "west": F.min(lon), "east": F.max(lon)}
    structs = [
        F.struct(F.lit(name).alias("edge"), value.alias("actual"), F.lit(float(bounds[name])).alias("expected"))
        for name, value in edges.items()
    ]
    rows = df.agg(F.array(*structs).alias("r")).select(F.inline("r"))
    return rows.withColumn("passed", F.abs(F.col("actual") - F.col("expected")) <= tolerance)


def temporal_completeness(df: DataFrame, ts: str, years: Sequence[int], min_share: float = MIN_HOUR_SHARE) -> DataFrame:
    """Distinct hours per expected year; a year without data shows as missing."""
    spark = df.sparkSession
    spine = spark.createDataFrame([(int(y),) for y in years], "year int")
    seen = df.groupBy(F.year(ts).alias("year")).agg(F.count_distinct(F.date_trunc("hour", ts)).alias("hours"))
    joined = spine.join(seen, "year", "left").withColumns(
        {"hours": F.coalesce("hours", F.lit(0)), "expected_hours": hours_in_year(F.col("year"))}
    )
    return joined.withColumn("passed", F.col("hours") >= F.col("expected_hours") * F.lit(min_share))


def value_quality(
    df: DataFrame,
    limits: dict[str, tuple[float, float]],
    by: Sequence[str] = (),
    max_null_percent: float = MAX_NULL_PERCENT,
) -> DataFrame:
    """Null percentage, minimum and maximum of each variable against its limits."""
    structs = []
    for c, (low, high) in limits.items():
        v = F.col(c)
        nulls = F.count_if(v.isNull()) * 100.0 / F.count(F.lit(1))
        ok = (nulls <= max_null_percent) & (F.min(v) >= low) & (F.max(v) <= high)
        structs.append(
            F.struct(
                F.lit(c).alias("variable"),
                nulls.alias("null_pct"),
                F.min(v).cast("double").alias("min"),
                F.max(v).cast("double").alias("max"),
                F.coalesce(ok, F.lit(False)).alias("passed"),
            )
        )
    grouped = df.groupBy(*by) if by else df
    return grouped.agg(F.array(*structs).alias("r")).select(*by, F.inline("r"))


def full_report(
    df: DataFrame,
    ts: str,
    years: Sequence[int],
    required: Sequence[str],
    bounds: dict[str, float],
    limits: dict[str, tuple[float, float]],
    lon: str = "lon",
    lat: str = "lat",
) -> DataFrame:
    """All checks for each expected year as (year, check, passed, message), one pass over the data."""
    spark = df.sparkSession
    missing = [c for c in required if c not in df.columns]
    spine = spark.createDataFrame([(int(y),) for y in years], "year int")
    v = {c: F.col(c) for c in limits if c in df.columns}
    seen = df.groupBy(F.year(ts).alias("year")).agg(
        F.count_distinct(F.date_trunc("hour", ts)).alias("hours"),
        *[f(c).alias(n) for n, f, c in (("s", F.min, lat), ("n", F.max, lat), ("w", F.min, lon), ("e", F.max, lon))],
        F.count(F.lit(1)).alias("rows"),
        *[a for c, col in v.items() for a in (
            F.count_if(col.isNull()).alias(f"null_{c}"), F.min(col).alias(f"min_{c}"), F.max(col).alias(f"max_{c}"))],
    )
    table = spine.join(seen, "year", "left")
    near = lambda c, side: F.abs(F.col(c) - F.lit(float(bounds[side]))) <= EXTENT_TOLERANCE
    checks: dict[str, tuple[Column, Column]] = {
        "file_exists": (F.col("rows").isNotNull(), F.when(F.col("rows").isNull(), "no data for year").otherwise("present")),
        "structure": (F.lit(not missing), F.lit(f"missing {missing}" if missing else "valid")),
        "spatial_coverage": (
            near("s", "south") & near("n", "north") & near("w", "west") & near("e", "east"),
            F.format_string("[%.1f..%.1f] [%.1f..%.1f]", "s", "n", "w", "e"),
        ),
        "temporal_coverage": (
            F.col("hours") >= hours_in_year(F.col("year")) * F.lit(MIN_HOUR_SHARE),
            F.format_string("%d/%d hours", F.col("hours"), hours_in_year(F.col("year"))),
        ),
    }
    for c in v:
        low, high = limits[c]
        pct = F.col(f"null_{c}") * 100.0 / F.col("rows")
        checks[f"quality_{c}"] = (
            (pct <= MAX_NULL_PERCENT) & (F.col(f"min_{c}") >= low) & (F.col(f"max_{c}") <= high),
            F.format_string("[%.1f..%.1f], %.2f%% missing", F.col(f"min_{c}"), F.col(f"max_{c}"), pct),
        )
    structs = [
        F.struct(
            F.lit(name).alias("check"),
            F.coalesce(ok, F.lit(False)).alias("passed"),
            F.when(F.col("rows").isNull(), "no data for year").otherwise(msg).alias("message"),
        )
        for name, (ok, msg) in checks.items()
    ]
    return table.select("year", F.inline(F.array(*structs)))


def reconcile_manifest(expected: DataFrame, actual: DataFrame, keys: Sequence[str] = ("record", "file")) -> DataFrame:
    """Expected files as valid, missing or corrupt by presence and size."""
    have = actual.select(*keys, F.col("size").alias("actual_size"))
    state = (
        F.when(F.col("actual_size").isNull(), "missing")
        .when(F.col("actual_size") != F.col("size"), "corrupt")
        .otherwise("valid")
    )
    return expected.join(have, list(keys), "left").withColumn("state", state)


def bytes_needed(reconciled: DataFrame, by: Sequence[str] = ("record",)) -> DataFrame:
    """Files and bytes still to be fetched."""
    wanted = F.col("state") != "valid"
    return reconciled.groupBy(*by).agg(
        F.count_if(wanted).alias("files_needed"),
        F.coalesce(F.sum(F.when(wanted, F.col("size"))), F.lit(0)).alias("bytes_needed"),
    )


def feature_validation(df: DataFrame, ranges: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Column-group counts, missing values and ranges of an engineered table."""
    groups = [(g, len(c)) for g, c in structure_report(df).items()]
    counts = df.sparkSession.createDataFrame(groups, "column_group string, n_columns int")
    return counts, missing_profile(df), range_profile(df, ranges) if ranges else None
