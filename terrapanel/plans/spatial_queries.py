"""Rasters, nearest neighbours, polygons and names."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terrapanel.functions.scalars import AlbersProjection, grid_key, pixel_center
from terrapanel.operators import spatial as SP
from terrapanel.operators.rollup import annual_summary
from terrapanel.plans import tables as T
from terrapanel.plans.registry import query
from terrapanel.sources.readers import bands_as_years, period_from_name, raster_band

# 0.5 degree cells over longitude 73..135 and latitude 18..55
X0, Y0, STEP, NCOLS, NROWS = 73.0, 55.0, 0.5, 124, 74


@query(
    "valid_pixels",
    """SELECT c.* FROM cells c WHERE ("row", "col") IN (SELECT ("row", "col") FROM cells
    WHERE period = (SELECT min(period) FROM cells) AND value > 0)""",
)
def valid_pixels(spark, sf):
    return SP.valid_pixels(T.cells(spark, sf))


@query(
    "grid_reference",
    """SELECT DISTINCT "row" || '_' || "col" AS grid_id, "row" AS grid_row, "col" AS grid_col,
    73 + ("col" + 0.5::DOUBLE) * 0.5 AS lon, 55 + ("row" + 0.5::DOUBLE) * -0.5 AS lat FROM cells""",
    "lon lat",
)
def grid_reference(spark, sf):
    x, y = pixel_center(F.col("row"), F.col("col"), F.lit(X0), F.lit(Y0), F.lit(STEP), F.lit(-STEP))
    pixels = T.cells(spark, sf).select("row", "col").distinct()
    return pixels.select(
        grid_key(F.col("row"), F.col("col")).alias("grid_id"),
        F.col("row").alias("grid_row"),
        F.col("col").alias("grid_col"),
        x.alias("lon"),
        y.alias("lat"),
    )


def _albers_sql() -> str:
    """The inverse projection written out with its constants."""
    p = AlbersProjection()
    e, e2, n, c, rho0 = p._shape()
    qp = (1 - e2) * (1 / (1 - e2) - math.log((1 - e) / (1 + e)) / (2 * e))
    a2, a4, a6 = (
        e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040,
        23 * e2**2 / 360 + 251 * e2**3 / 3780,
        761 * e2**3 / 45360,
    )
    return f""", m AS (SELECT DISTINCT "row", "col", ("col" - 62) * 40000.0::DOUBLE AS x,
      {rho0!r}::DOUBLE - (110 - "row") * 50000.0::DOUBLE AS y FROM cells),
    b AS (SELECT *, asin(({c!r}::DOUBLE - (x * x + y * y) * ({n / p.semi_major!r}::DOUBLE) ** 2) / {n!r}::DOUBLE / {qp!r}::DOUBLE) AS beta FROM m)
    SELECT "row", "col", 105 + degrees(atan2(x, y) / {n!r}::DOUBLE) AS lon,
    degrees(beta + {a2!r}::DOUBLE * sin(2 * beta) + {a4!r}::DOUBLE * sin(4 * beta) + {a6!r}::DOUBLE * sin(6 * beta)) AS lat FROM b"""


@query("albers_to_lonlat", _albers_sql(), "lon lat")
def albers_to_lonlat(spark, sf):
    """Cell centres of a metre grid turned into longitude and latitude."""
    lon, lat = AlbersProjection().to_lonlat(F.col("x"), F.col("y"))
    pixels = T.cells(spark, sf).select("row", "col").distinct()
    metres = pixels.select("row", "col", ((F.col("col") - 62) * 40000.0).alias("x"), ((110 - F.col("row")) * 50000.0).alias("y"))
    return metres.select("row", "col", lon.alias("lon"), lat.alias("lat"))


@query(
    "raster_sample",
    """SELECT point_id, period, value FROM (SELECT *, CAST(floor((55 - lat) / 0.5) AS INT) AS r,
    CAST(floor((lon - 73) / 0.5) AS INT) AS c FROM places) p JOIN cells ON p.r = "row" AND p.c = "col" """,
)
def raster_sample(spark, sf):
    sampled = SP.raster_sample(T.places(spark, sf), T.cells(spark, sf), X0, Y0, STEP, STEP)
    return sampled.select("point_id", "period", "value")


@query(
    "zonal_mean",
    """, one AS (SELECT "row", "col", sum(value) AS value FROM cells GROUP BY 1, 2)
    SELECT point_id, avg(value) AS canopy_share, count(*) AS n_cells FROM places JOIN one ON
    73 + "col" * 0.5 < lon + 0.7 AND 73 + ("col" + 1) * 0.5 > lon - 0.7 AND
    55 - "row" * 0.5 > lat - 0.7 AND 55 - ("row" + 1) * 0.5 < lat + 0.7 AND value >= 0 GROUP BY 1""",
    "canopy_share:5",
)
def zonal_mean(spark, sf):
    one = T.cells(spark, sf).groupBy("row", "col").agg(F.sum("value").alias("value"))
    return SP.zonal_mean(T.places(spark, sf), one, X0, Y0, STEP, STEP, buffer=0.7, keys=["point_id"])


_LON_AXIS, _LAT_AXIS = (73.25, 0.5, 124), (18.25, 0.5, 74)
_NEAREST = """, near AS (SELECT point_id, lon, lat,
  CAST(greatest(0, least(floor((lon - 73.25) / 0.5 + 0.5), 123)) AS INT) AS lon_idx,
  CAST(greatest(0, least(floor((lat - 18.25) / 0.5 + 0.5), 73)) AS INT) AS lat_idx FROM places),
 dist AS (SELECT *, sqrt((lon - (73.25 + lon_idx * 0.5)) ** 2 + (lat - (18.25 + lat_idx * 0.5)) ** 2) AS distance FROM near)
"""


@query("nearest_cell", _NEAREST + "SELECT point_id, lon_idx, lat_idx, distance FROM dist", "distance")
def nearest_cell(spark, sf):
    out = SP.nearest_cell(T.places(spark, sf), _LON_AXIS, _LAT_AXIS)
    return out.select("point_id", "lon_idx", "lat_idx", "distance")


@query(
    "nearest_values",
    _NEAREST + """SELECT point_id, period, value FROM dist JOIN cells ON lon_idx = "col" AND 73 - lat_idx = "row" """,
)
def nearest_values(spark, sf):
    cube = T.cells(spark, sf).select(
        F.col("col").alias("lon_idx"), (F.lit(NROWS - 1) - F.col("row")).alias("lat_idx"), "period", "value"
    )
    return SP.nearest_values(T.places(spark, sf), cube, _LON_AXIS, _LAT_AXIS).select("point_id", "period", "value")


@query(
    "match_distance",
    _NEAREST + """SELECT max(distance) AS max_degrees, avg(distance) AS mean_degrees, max(distance) * 111 AS max_km,
    avg(distance) * 111 AS mean_km FROM dist""",
    "max_degrees mean_degrees max_km mean_km",
)
def match_distance(spark, sf):
    return SP.match_distance_summary(SP.nearest_cell(T.places(spark, sf), _LON_AXIS, _LAT_AXIS))


_AXIS = [54.0, 50.0, 47.5, 44.0, 40.0, 33.0, 32.0, 25.0, 21.0, 19.5]


@query(
    "nearest_on_axis",
    """, axis AS (SELECT unnest(range(10)) AS i, unnest([54.0, 50.0, 47.5, 44.0, 40.0, 33.0, 32.0, 25.0, 21.0, 19.5]) AS a)
    SELECT point_id, CAST(arg_min(i, CAST(abs(lat - a) AS DOUBLE) + i * 1e-9) AS INT) AS lat_idx FROM places, axis GROUP BY 1""",
)
def nearest_on_axis(spark, sf):
    return SP.nearest_on_axis(T.places(spark, sf), "lat", _AXIS, "lat_idx").select("point_id", "lat_idx")


def nation_boxes(spark, sf):
    """One rectangle per nation."""
    k = F.col("n_nationkey")
    west, south = F.lit(73.0) + F.lit(12.4) * (k % 5), F.lit(18.0) + F.lit(7.4) * F.floor(k / 5)

    def corner(x, y):
        return F.struct(x.alias("lon"), y.alias("lat"))

    ring = F.array(
        corner(west, south), corner(west + 12.4, south), corner(west + 12.4, south + 7.4), corner(west, south + 7.4)
    )
    return T.table(spark, sf, "nation").select("n_name", SP.ring_edges(ring).alias("edges"))


@query(
    "point_in_polygon",
    """, box AS (SELECT n_name, 73.0::DOUBLE + 12.4::DOUBLE * (n_nationkey % 5) AS w,
      18.0::DOUBLE + 7.4::DOUBLE * floor(n_nationkey / 5) AS s FROM nation)
    SELECT point_id, n_name FROM places LEFT JOIN box ON lon > w AND lon < w + 12.4::DOUBLE AND lat > s AND lat < s + 7.4::DOUBLE""",
)
def point_in_polygon(spark, sf):
    out = SP.point_in_polygon(T.places(spark, sf), nation_boxes(spark, sf), ["n_name"], "point_id", size=2.0)
    return out.select("point_id", "n_name")


_NEAREST_SUPPLIER = """, ax AS (SELECT s_acctbal AS x, min(s_suppkey) AS i FROM supplier GROUP BY 1),
 d AS (SELECT c_custkey, i, abs(c_acctbal - x) AS gap FROM customer, ax),
 m AS (SELECT c_custkey, min(gap) AS gap FROM d GROUP BY 1)
 SELECT c_custkey, min(i) AS s_suppkey FROM d JOIN m USING (c_custkey, gap) GROUP BY 1"""


@query("nearest_in_table", _NEAREST_SUPPLIER)
def nearest_in_table(spark, sf):
    """The supplier of the balance nearest to each customer's."""
    customers = T.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    axis = T.table(spark, sf, "supplier")
    return SP.nearest_in_table(customers, "c_acctbal", axis, "s_acctbal", "s_suppkey", "s_suppkey", 1000).select("c_custkey", "s_suppkey")


# Areas of one nation each: a notched (concave) ring with a square hole; neighbours share borders, every third also overlaps the next.
_AREA = {
    "ring": ((0.0, 0.0), (12.4, 0.0), (12.4, 7.4), (7.1, 7.4), (6.2, 2.3), (5.3, 7.4), (0.0, 7.4)),
    "hole": ((1.1, 1.2), (3.4, 1.2), (3.4, 3.3), (1.1, 3.3)),
}
_EDGE_VALUES = ", ".join(
    f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)"
    for ring in _AREA.values() for a, b in zip(ring, (*ring[1:], ring[0]))
)


@query(
    "area_of_point",
    f""", area AS (SELECT n_name, n_regionkey, 73.0::DOUBLE + 12.4::DOUBLE * (n_nationkey % 5) + CASE WHEN n_nationkey % 3 = 0 THEN 1.7::DOUBLE ELSE 0 END AS w,
      18.0::DOUBLE + 7.4::DOUBLE * floor(n_nationkey / 5) AS s FROM nation),
    e AS (SELECT n_name, n_regionkey, w + a AS x1, s + b AS y1, w + c AS x2, s + d AS y2 FROM area, (VALUES {_EDGE_VALUES}) v(a, b, c, d)),
    p AS (SELECT point_id, lon AS x, lat AS y FROM places),
    t AS (SELECT point_id, n_name, n_regionkey, x, y, x1, y1, x2, y2, (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1) AS turn FROM p, e),
    h AS (SELECT point_id, n_name, n_regionkey FROM t GROUP BY 1, 2, 3 HAVING
      count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND CASE WHEN y2 > y1 THEN turn > 0 ELSE turn < 0 END) % 2 = 1 AND count(*) FILTER (WHERE
      turn = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) = 0)
    SELECT point_id, n_name, r_name FROM p LEFT JOIN h USING (point_id) LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def area_of_point(spark, sf):
    """Attributes of every area that strictly contains a point: concave rings, holes, shared borders, overlaps."""
    k = F.col("n_nationkey")
    west = F.lit(73.0) + F.lit(12.4) * (k % 5) + F.when(k % 3 == 0, 1.7).otherwise(0.0)
    south = F.lit(18.0) + F.lit(7.4) * F.floor(k / 5)

    def ring(points):
        return SP.ring_edges(F.array(*[F.struct((west + x).alias("lon"), (south + y).alias("lat")) for x, y in points]))

    areas = T.table(spark, sf, "nation").join(T.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        "n_name", "r_name", F.concat(*[ring(r) for r in _AREA.values()]).alias("edges")
    )
    found = SP.point_in_polygon(T.places(spark, sf), areas, ["n_name", "r_name"], "point_id", size=4.0)
    return found.select("point_id", "n_name", "r_name")


@query(
    "boundary_attributes",
    """, boundary AS (SELECT n_name AS city_name, printf('CN%03d', n_nationkey) AS code, printf('P%02d', n_regionkey) AS area_code FROM nation WHERE n_nationkey % 4 <> 3)
    SELECT year, city_name, province, code, area_code, canopy_share, ln_elec_kwh, high_temp_days FROM (
      SELECT year, city_name, province, avg(canopy_share) AS canopy_share, avg(ln_elec_kwh) AS ln_elec_kwh,
        CAST(sum(days_in_bin_30_35 + days_in_bin_35_40 + days_in_bin_40_plus) AS BIGINT) AS high_temp_days
      FROM grid_panel WHERE year IN (1996, 1998, 2000) GROUP BY 1, 2, 3) JOIN boundary USING (city_name)""",
    "canopy_share ln_elec_kwh",
)
def boundary_attributes(spark, sf):
    """Annual city summary with codes from the boundary table; cities without a boundary drop out."""
    names = T.table(spark, sf, "nation").filter(F.col("n_nationkey") % 4 != 3).select(
        F.col("n_name").alias("ADM2_EN"), F.format_string("CN%03d", "n_nationkey").alias("code"),
        F.format_string("P%02d", "n_regionkey").alias("area_code"),
    )
    hot = ["days_in_bin_30_35", "days_in_bin_35_40", "days_in_bin_40_plus"]
    chosen = T.grid_panel(spark, sf).filter(F.col("year").isin(1996, 1998, 2000))
    return SP.with_boundary(annual_summary(chosen, ["city_name", "province"], hot), names)


_PATTERN = "'nation_' || (n_nationkey % 10) || CASE WHEN n_nationkey % 3 = 0 THEN '[0-4]$' WHEN n_nationkey % 3 = 1 THEN '$' ELSE '.?' END"


@query(
    "name_match_by_pattern",
    f""", pats AS (SELECT n_name, {_PATTERN} AS pattern FROM nation)
    SELECT n_name, pattern, arg_min(hay, c_custkey) AS hay, min(c_custkey) AS c_custkey FROM pats JOIN (
    SELECT c_custkey, c_name || ' nation_' || c_nationkey AS hay FROM customer) h ON regexp_matches(lower(hay), lower(pattern)) GROUP BY 1, 2""",
)
def name_match_by_pattern(spark, sf):
    k = F.col("n_nationkey")
    tail = F.when(k % 3 == 0, "[0-4]$").when(k % 3 == 1, "$").otherwise(".?")
    needles = T.table(spark, sf, "nation").select("n_name", F.concat(F.lit("nation_"), (k % 10).cast("string"), tail).alias("pattern"))
    hay = T.table(spark, sf, "customer").select(
        "c_custkey", F.concat_ws(" ", "c_name", F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"))).alias("hay")
    )
    return SP.first_name_match(needles, "pattern", hay, "hay", "c_custkey", literal=False)


@query(
    "first_name_match",
    """SELECT n_name, arg_min(hay, c_custkey) AS hay, min(c_custkey) AS c_custkey FROM nation JOIN (
    SELECT c_custkey, c_name || ' nation_' || c_nationkey AS hay FROM customer) h
    ON contains(lower(hay), lower(trim(n_name))) GROUP BY 1""",
)
def first_name_match(spark, sf):
    hay = T.table(spark, sf, "customer").select(
        "c_custkey", F.concat_ws(" ", "c_name", F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"))).alias("hay")
    )
    needles = T.table(spark, sf, "nation").select("n_name")
    return SP.first_name_match(needles, "n_name", hay, "hay", "c_custkey")


@query(
    "raster_band",
    """SELECT period - 1989 AS band, "row", "col", value FROM cells WHERE period - 1989 = 1997 - 1990 + 1""",
)
def one_band(spark, sf):
    banded = T.cells(spark, sf).select((F.col("period") - 1989).alias("band"), "row", "col", "value")
    return raster_band(banded, 1997)


@query("bands_as_years", """SELECT "row", "col", value, period - 1989 AS band, period AS year FROM cells""")
def all_bands(spark, sf):
    return bands_as_years(T.cells(spark, sf).select("row", "col", "value", (F.col("period") - 1989).alias("band")))


@query(
    "file_name_periods",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month FROM orders""",
)
def file_name_periods(spark, sf):
    """Year and month read back from names like ``t2m_1997_5.nc``."""
    name = F.format_string("t2m_%d_%d.nc", F.year("o_orderdate"), F.month("o_orderdate"))
    fields = period_from_name(F.col("name"), "year_and_month")
    named = T.table(spark, sf, "orders").select("o_orderkey", name.alias("name"))
    return named.select("o_orderkey", *[c.alias(n) for n, c in fields.items()])
