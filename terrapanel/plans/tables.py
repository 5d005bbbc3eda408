"""The domain tables, derived from the given star-schema tables in Spark and in SQL.

A supplier stands for a grid cell, its nation for a city and its region for a province;
line items are the measurements. Money and rates are added up as whole cents so that both
engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.functions.bins import TEMPERATURE_BINS, Bin
from terrapanel.functions.scalars import kelvin_to_celsius, shift_hours
from terrapanel.operators.panel import add_canopy_products
from terrapanel.operators.timeseries import local_daily_max, monthly_bin_counts
from terrapanel.session import checkpointed
from terrapanel.sources.layout import bucketed

YEARS = {"train": range(1990, 2000), "validation": (2000,), "test": (2001,)}
MEASURES = ["elec_kwh", "rhu", "prec", "canopy_share", "population", "gdp_per_capita", "nightlight"]
PREDICTORS = ["rhu", "prec", "canopy_share", "population", "gdp_per_capita", "nightlight"]
VALUE_BINS = (Bin("0_25", 0, 25), Bin("25_50", 25, 50), Bin("50_100", 50, 100), Bin("100_plus", 100, 1000))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str) -> Column:
    return F.floor(F.col(c) * 100 + 0.5)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid_id, year, month) measures."""
    n = F.count(F.lit(1))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("grid_id"),
            F.year("l_shipdate").alias("year"),
            F.month("l_shipdate").alias("month"),
        )
        .agg(
            (F.sum(_cents("l_extendedprice")).cast("double") / 100).alias("elec_kwh"),
            (F.avg("l_quantity") * 2).alias("rhu"),
            (F.sum(_cents("l_tax")).cast("double") * 10 / n).alias("prec"),
            (F.min("l_discount") * 9).alias("canopy_share"),
            n.alias("population"),
            F.max("l_extendedprice").alias("gdp_per_capita"),
            F.count_if(F.col("l_returnflag") == "R").alias("nightlight"),
        )
    )


def stored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel written once, for plans that pass over it several times.

    It is far smaller than the line items it is made from, so later passes start there.
    """
    return checkpointed(panel(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str, strict_month: bool = False) -> DataFrame:
    """Daily maximum temperature per grid cell, in local time."""
    kelvin = F.col("l_quantity") * 1.3 + 253.15
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "grid_id")
    return local_daily_max(
        lines, ["grid_id"], "l_shipdate", kelvin_to_celsius(kelvin), strict_month=strict_month, name="tmax"
    )


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_bin_counts(daily(spark, sf_dir), ["grid_id"], "tmax")


def place(key: str) -> tuple[Column, Column]:
    k = F.col(key)
    return F.lit(73) + (k * 37 % 620) / F.lit(10.0), F.lit(18) + (k * 53 % 370) / F.lit(10.0)


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid_id to city and province, with coordinates."""
    lon, lat = place("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            F.col("s_suppkey").alias("grid_id"),
            F.col("n_nationkey").alias("city_id"),
            F.col("n_name").alias("city_name"),
            F.col("r_name").alias("province"),
            lon.alias("lon"),
            lat.alias("lat"),
        )
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the line items per grid, month and local day, in buckets of the grid.

    Panel and day counts both follow from it, each inside its bucket, so the line items are read
    and shuffled once.
    """
    day = F.to_date(shift_hours(F.col("l_shipdate"), 8))
    sums = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("grid_id"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), day.alias("day"))
        .agg(
            F.sum(_cents("l_extendedprice")).alias("price"),
            F.sum("l_quantity").alias("quantity"),  # whole numbers, so exact in any order
            F.sum(_cents("l_tax")).alias("tax"),
            F.min("l_discount").alias("discount"),
            F.count(F.lit(1)).alias("n"),
            F.max("l_extendedprice").alias("highest"),
            F.count_if(F.col("l_returnflag") == "R").alias("returned"),
            F.max(kelvin_to_celsius(F.col("l_quantity") * 1.3 + 253.15)).alias("tmax"),
        )
    )
    return bucketed(sums, "grid_id", int(spark.conf.get("spark.sql.shuffle.partitions")), ("year", "month"))


def panel_and_days(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The panel and the day counts from stored measurements."""
    n = F.sum("n")
    measures = stored.groupBy("grid_id", "year", "month").agg(
        (F.sum("price").cast("double") / 100).alias("elec_kwh"),
        (F.sum("quantity") / n * 2).alias("rhu"),
        (F.sum("tax").cast("double") * 10 / n).alias("prec"),
        (F.min("discount") * 9).alias("canopy_share"),
        n.alias("population"),
        F.max("highest").alias("gdp_per_capita"),
        F.sum("returned").alias("nightlight"),
    )
    # A local day may take hours of two months.
    daily_max = stored.groupBy("grid_id", "day").agg(F.max("tmax").alias("tmax"))
    return measures, monthly_bin_counts(daily_max, ["grid_id"], "tmax")


def grid_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integrated panel: measures, city, day counts and canopy products."""
    measures, counts = panel_and_days(measurements(spark, sf_dir))
    joined = measures.join(counts, ["grid_id", "year", "month"], "left").join(cities(spark, sf_dir), "grid_id", "left")
    return add_canopy_products(joined).withColumn("ln_elec_kwh", F.log("elec_kwh"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to locate: one per customer."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("point_id"),
        (F.lit(73) + (k * 37 % 6200) / F.lit(100.0)).alias("lon"),
        (F.lit(18) + (k * 53 % 3700) / F.lit(100.0)).alias("lat"),
        F.col("c_acctbal").alias("weight"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster cells at 0.5 degrees over the study area, one band per year, from orders."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.year("o_orderdate").alias("period"),
            (F.col("o_orderkey") * 7 % 74).cast("int").alias("row"),
            (F.col("o_orderkey") * 11 % 124).cast("int").alias("col"),
        )
        .agg((F.sum(_cents("o_totalprice")).cast("double") / 100).alias("value"))
    )


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures from orders, with a customer as grid cell: a source that lacks many months of the panel."""
    cents = _cents("o_totalprice")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("grid_id"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
        .agg(
            (F.sum(cents).cast("double") / 100 / F.count(F.lit(1))).alias("rhu"),
            (F.max(cents) % 997).cast("double").alias("prec"),
            (F.min(cents) % 10).cast("double").alias("canopy_share"),
            F.count(F.lit(1)).alias("population"),
            F.max("o_totalprice").alias("gdp_per_capita"),
            F.count_if(F.col("o_orderstatus") == "F").alias("nightlight"),
        )
    )


# --- the same tables in SQL -----------------------------------------------------------

_DAY_COUNTS = ",\n".join(
    f"count(*) FILTER (WHERE tmax >= {b.low}" + (f" AND tmax < {b.high}" if i < 11 else "") + f") AS days_in_{b.name}"
    for i, b in enumerate(TEMPERATURE_BINS)
)
DAY_NAMES = [f"days_in_{b.name}" for b in TEMPERATURE_BINS]
_PRODUCTS = ", ".join(f"{d} * canopy_share AS {d}_x_canopy" for d in DAY_NAMES)

_CTES = f"""
panel AS (
  SELECT l_suppkey AS grid_id, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
    CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS elec_kwh,
    avg(l_quantity) * 2 AS rhu,
    CAST(sum(CAST(floor(l_tax * 100 + 0.5) AS BIGINT)) AS DOUBLE) * 10 / count(*) AS prec,
    min(l_discount) * 9 AS canopy_share,
    count(*) AS population,
    max(l_extendedprice) AS gdp_per_capita,
    count(*) FILTER (WHERE l_returnflag = 'R') AS nightlight
  FROM lineitem GROUP BY 1, 2, 3),
daily AS (
  SELECT l_suppkey AS grid_id, CAST(l_shipdate + INTERVAL 8 HOUR AS DATE) AS day,
    max(l_quantity * CAST(1.3 AS DOUBLE) + CAST(253.15 AS DOUBLE) - CAST(273.15 AS DOUBLE)) AS tmax
  FROM lineitem GROUP BY 1, 2),
days AS (
  SELECT grid_id, CAST(year(day) AS INT) AS year, CAST(month(day) AS INT) AS month, {_DAY_COUNTS}
  FROM daily GROUP BY 1, 2, 3),
cities AS (
  SELECT s_suppkey AS grid_id, n_nationkey AS city_id, n_name AS city_name, r_name AS province,
    73 + (s_suppkey * 37 % 620) / CAST(10.0 AS DOUBLE) AS lon, 18 + (s_suppkey * 53 % 370) / CAST(10.0 AS DOUBLE) AS lat
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
grid_panel AS (
  SELECT p.*, d.* EXCLUDE (grid_id, year, month), c.* EXCLUDE (grid_id), {_PRODUCTS}, ln(elec_kwh) AS ln_elec_kwh
  FROM panel p LEFT JOIN days d USING (grid_id, year, month) LEFT JOIN cities c USING (grid_id)),
places AS (
  SELECT c_custkey AS point_id, 73 + (c_custkey * 37 % 6200) / CAST(100.0 AS DOUBLE) AS lon,
    18 + (c_custkey * 53 % 3700) / CAST(100.0 AS DOUBLE) AS lat, c_acctbal AS weight FROM customer),
orders_panel AS (
  SELECT o_custkey AS grid_id, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
    CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS rhu,
    CAST(max(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) % 997 AS DOUBLE) AS prec,
    CAST(min(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) % 10 AS DOUBLE) AS canopy_share,
    count(*) AS population, max(o_totalprice) AS gdp_per_capita,
    count(*) FILTER (WHERE o_orderstatus = 'F') AS nightlight
  FROM orders GROUP BY 1, 2, 3),
cells AS (
  SELECT CAST(year(o_orderdate) AS INT) AS period, CAST(o_orderkey * 7 % 74 AS INT) AS "row",
    CAST(o_orderkey * 11 % 124 AS INT) AS "col",
    CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS value
  FROM orders GROUP BY 1, 2, 3)
"""


def with_tables(sql: str) -> str:
    """Prefix a SELECT (or further CTEs, ``, name AS (...) SELECT``) with the table definitions.

    ``, recursive name AS (...)`` starts further CTEs of which the first refers to itself.
    """
    body = sql.strip()
    if body.startswith(", recursive "):
        return f"WITH RECURSIVE {_CTES}, {body.removeprefix(', recursive ')}"
    return f"WITH {_CTES}{body}"
