"""Table readers. Paths may name files, folders or globs on any Spark file system."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.functions.scalars import kelvin_to_celsius, nan_to_null, shift_hours
from terrapanel.operators.panel import derive_entity_id
from terrapanel.operators.sampling import forward_fill
from terrapanel.operators.spatial import band_of_year, ring_edges
from terrapanel.sources import schemas


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the path's own file system, local or remote; globs count if they match."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(where)
    return found is not None and len(found) > 0


def grid_panel(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Integrated grid panel; a missing path is an error."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.schema(schema) if schema else spark.read
    return nan_to_null(reader.parquet(path))


def city_panel(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """City panel from CSV with ``city_id`` derived where absent."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.schema(schema or schemas.CITY_PANEL).option("header", True).csv(path)
    return derive_entity_id(nan_to_null(df))


def city_list(spark: SparkSession, path: str, fill: Sequence[str] = ("Province",)) -> DataFrame:
    """City list: byte-order mark stripped from the header, sparse columns filled down.

    ``line_no`` numbers the rows of this single file in reading order.
    """
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    # Ids rise within a file and from split to split; they are made dense by the fill's order only.
    numbered = df.withColumn("line_no", F.monotonically_increasing_id())
    return forward_fill(numbered, "line_no", list(fill), chunk=1 << 33)


def raster_cells(spark: SparkSession, path: str, period: str | None = None) -> DataFrame:
    """Long raster table; one period reads only its own folder when partitioned by it."""
    df = spark.read.schema(schemas.RASTER_CELL).parquet(path)
    return df.filter(F.col("period") == period) if period else df


def raster_band(cells: DataFrame, year: Column | int, first_year: int = 1990) -> DataFrame:
    """Cells of the band that stands for ``year``."""
    y = F.lit(year) if isinstance(year, int) else year
    return cells.filter(F.col("band") == band_of_year(y, first_year))


def bands_as_years(cells: DataFrame, first_year: int = 1990) -> DataFrame:
    return cells.withColumn("year", F.col("band") + F.lit(first_year - 1))


def gridded_month(
    spark: SparkSession, path: str, variable: str | None = None, years: tuple[int, int] = (2012, 2019)
) -> DataFrame:
    """Monthly gridded variable limited to a span of years at the scan."""
    df = spark.read.schema(schemas.GRIDDED_MONTH).parquet(path)
    df = df.filter(F.col("year").between(*years))
    if variable:
        df = df.filter(F.col("variable") == variable)
    return nan_to_null(df)


def hourly_cube(spark: SparkSession, path: str, hours: int = 8) -> DataFrame:
    """Hourly temperatures in Celsius with a local time column beside the UTC one."""
    df = nan_to_null(spark.read.schema(schemas.CUBE_HOURLY).parquet(path))
    return df.withColumns(
        {
            "local_time": shift_hours(F.col("valid_time"), hours),
            "t2m": kelvin_to_celsius(F.col("t2m")),
            "d2m": kelvin_to_celsius(F.col("d2m")),
        }
    )


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Polygon table with an edge list per polygon; coordinates are WGS84."""
    df = spark.read.schema(schemas.BOUNDARY).parquet(path)
    return df.withColumn("edges", ring_edges(F.col("ring")))


# Regular expressions for the period in a file name: (pattern, year group, month group).
# The naming rules of the source archives.
FILE_PERIODS = {
    "year_month": (r"(\d{4})(\d{2})\.[^.]*$", 1, 2),
    "tagged_year": (r"^[^_]*_.(\d{4})", 1, None),
    "year_and_month": (r"(\d{4})_(\d{1,2})\.[^.]*$", 1, 2),
    "month_only": (r"_(\d{1,2})\.[^.]*$", None, 1),
}


def period_from_name(name: Column, rule: str) -> dict[str, Column]:
    """Year and/or month columns read off a file name."""
    pattern, year, month = FILE_PERIODS[rule]
    out = {}
    for field, group in (("year", year), ("month", month)):
        if group:
            text = F.regexp_extract(name, pattern, group)
            out[field] = F.when(text != "", text).try_cast("int")
    return out


def with_file_period(df: DataFrame, rule: str) -> DataFrame:
    """Period of the file each row came from; ``df`` must be a direct file scan."""
    return df.withColumns(period_from_name(F.col("_metadata.file_name"), rule))


def optional_sources(spark: SparkSession, paths: dict[str, str]) -> tuple[dict[str, DataFrame], list[str]]:
    """Sources whose path exists, and the names of those without one."""
    found = {n: nan_to_null(spark.read.parquet(p)) for n, p in paths.items() if path_exists(spark, p)}
    return found, [n for n in paths if n not in found]


def subset(df: DataFrame, periods: int = 6, entities: int = 1000, entity: str = "grid_id") -> DataFrame:
    """Trial-run subset: the first periods and the first entities in key order."""
    first = df.select("year", "month").distinct().orderBy("year", "month").limit(periods)
    some = df.select(entity).distinct().orderBy(entity).limit(entities)
    return df.join(first, ["year", "month"], "left_semi").join(some, entity, "left_semi")
