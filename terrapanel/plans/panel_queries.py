"""Panel integration, rollups and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.functions.scalars import cyclic_month, month_label, compact_month_label, products_with, shift_hours
from terrapanel.operators import panel as P
from terrapanel.operators import rollup as R
from terrapanel.operators import timeseries as TS
from terrapanel.plans import tables as T
from terrapanel.plans.registry import query
from terrapanel.sources.layout import bucketed

_MEANS = [*T.DAY_NAMES, "canopy_share", "nightlight", "gdp_per_capita", "prec", "rhu", "lon", "lat",
          *[f"{d}_x_canopy" for d in T.DAY_NAMES]]
_CITY_SQL = f"""
SELECT {{keys}}, year, month, sum(elec_kwh) AS elec_kwh, CAST(sum(population) AS BIGINT) AS population,
  min(province) AS province, {", ".join(f"avg({c}) AS {c}" for c in _MEANS)},
  count(DISTINCT grid_id) AS grid_count, printf('%d_%02d', year, month) AS year_month
FROM grid_panel WHERE city_name IS NOT NULL GROUP BY {{keys}}, year, month
"""
_CITY_ROUND = "elec_kwh:4 " + " ".join(_MEANS).replace("gdp_per_capita", "gdp_per_capita:8")


@query("city_month_rollup", _CITY_SQL.format(keys="city_name"), _CITY_ROUND)
def city_month_rollup(spark, sf):
    return R.city_month_panel(T.grid_panel(spark, sf), unique_rows=True)


@query("city_month_rollup_by_id", _CITY_SQL.format(keys="city_id, city_name"), _CITY_ROUND)
def city_month_rollup_by_id(spark, sf):
    return R.city_month_panel(T.grid_panel(spark, sf), ("city_id", "city_name", "year", "month"))


_SOURCE_SQL = """
SELECT city_id, city_name, year, month, {agg} AS {col}, min(province) AS province, count(*) AS n_grids,
  printf('%d_%02d', year, month) AS year_month
FROM panel JOIN cities USING (grid_id) WHERE city_name IS NOT NULL GROUP BY 1, 2, 3, 4
"""


def _source(column: str, how: str):
    def plan(spark, sf):
        source = T.panel(spark, sf).select("grid_id", "year", "month", column)
        return R.source_rollup(source, T.cities(spark, sf), column, how)

    return plan


for _col, _how in (
    ("population", "sum"), ("gdp_per_capita", "mean"), ("nightlight", "mean"), ("prec", "mean"), ("rhu", "mean"),
):
    _agg = f"CAST(sum({_col}) AS BIGINT)" if _how == "sum" else f"avg({_col})"
    query(f"source_rollup_{_col}", _SOURCE_SQL.format(agg=_agg, col=_col), "" if _how == "sum" else f"{_col}:8")(
        _source(_col, _how)
    )


@query(
    "annual_to_monthly",
    """SELECT c_nationkey AS grid_id, CAST(year(o_orderdate) AS INT) AS year, count(*) AS population,
       CAST(m.month AS INT) AS month
    FROM orders JOIN customer ON o_custkey = c_custkey, (SELECT unnest(range(1, 13)) AS month) m GROUP BY 1, 2, 4""",
)
def annual_to_monthly(spark, sf):
    annual = (
        T.table(spark, sf, "orders")
        .join(T.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("grid_id"), F.year("o_orderdate").alias("year"))
        .agg(F.count(F.lit(1)).alias("population"))
    )
    return P.replicate_annual(annual)


_STAR_KEYS = {
    "climate": ("grid_id", "year", "month"),
    "lights": ("grid_id", "year", "month"),
    "wealth": ("grid_id", "year", "month"),
    "canopy": ("grid_id", "year"),
    "city": ("grid_id",),
    "absent": ("grid_id", "year", "month"),
}


def _star(spark, sf):
    """Base and sources of the panel, each stored once in the same buckets of the grid."""
    keys = ["grid_id", "year", "month"]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = bucketed(T.panel(spark, sf).select(*keys, "elec_kwh"), "grid_id", buckets, ("year", "month"))
    monthly = bucketed(T.orders_panel(spark, sf), "grid_id", buckets, ("year", "month"))
    sources = {
        "climate": monthly.select(*keys, "rhu", "prec"),
        "lights": monthly.select(*keys, "nightlight", "population"),
        "wealth": monthly.select(*keys, "gdp_per_capita"),
        # an aggregation inside the bucket
        "canopy": monthly.groupBy("grid_id", "year").agg(F.min("canopy_share").alias("canopy_share")),
        "city": bucketed(T.cities(spark, sf).select("grid_id", "city_name", "province"), "grid_id", buckets),
        "absent": None,
    }
    return base, sources


_STAR_SQL = """
, sp AS (SELECT * FROM orders_panel),
an AS (SELECT grid_id, year, min(canopy_share) AS canopy_share FROM sp GROUP BY 1, 2)
SELECT b.grid_id, b.year, b.month, b.elec_kwh, {cols}, c.city_name, c.province{more}
FROM panel b LEFT JOIN sp s ON b.grid_id = s.grid_id AND b.year = s.year AND b.month = s.month
LEFT JOIN an a ON b.grid_id = a.grid_id AND b.year = a.year LEFT JOIN cities c ON b.grid_id = c.grid_id
"""
_PLAIN = "s.rhu, s.prec, s.nightlight, s.population, s.gdp_per_capita, a.canopy_share"
_FILLED = """coalesce(s.rhu, 0) AS rhu, coalesce(s.prec, 0) AS prec, coalesce(s.nightlight, 0) AS nightlight,
coalesce(s.population, 0) AS population, {gdp} AS gdp_per_capita, {canopy} AS canopy_share"""


@query("integrate_star_left_join", _STAR_SQL.format(cols=_PLAIN, more=""))
def integrate_star_left_join(spark, sf):
    base, sources = _star(spark, sf)
    return P.left_join_sources(base, sources, _STAR_KEYS)[0]


@query(
    "effective_fill",
    _STAR_SQL.format(
        cols=_FILLED.format(gdp="s.gdp_per_capita", canopy="a.canopy_share"),
        more=", printf('%d_%02d', b.year, b.month) AS year_month",
    ),
)
def effective_fill(spark, sf):
    base, sources = _star(spark, sf)
    return P.integrate_panel(base, sources, _STAR_KEYS)


@query(
    "intended_fill",
    _STAR_SQL.format(
        cols=_FILLED.format(gdp="coalesce(s.gdp_per_capita, 0)", canopy="coalesce(a.canopy_share, 0)"),
        more=", printf('%d_%02d', b.year, b.month) AS year_month",
    ),
)
def intended_fill(spark, sf):
    base, sources = _star(spark, sf)
    return P.integrate_panel(base, sources, _STAR_KEYS, fill=P.INTENDED_FILL)


@query(
    "canopy_products",
    f"SELECT grid_id, year, month, {', '.join(f'{d}_x_canopy' for d in T.DAY_NAMES)} FROM grid_panel",
    " ".join(f"{d}_x_canopy" for d in T.DAY_NAMES),
)
def canopy_products(spark, sf):
    keys = ["grid_id", "year", "month"]
    joined = T.panel(spark, sf).select(*keys, "canopy_share").join(T.days(spark, sf), keys, "left")
    return joined.select(*keys, *[c.alias(n) for n, c in products_with(T.DAY_NAMES, "canopy_share", "_x_canopy").items()])


@query(
    "measure_validity",
    """SELECT grid_id, year, month, nightlight, gdp_per_capita FROM panel
    WHERE nightlight >= 0 AND gdp_per_capita > 0 AND gdp_per_capita <> 100000 AND elec_kwh > 0""",
)
def measure_validity(spark, sf):
    out = P.keep_valid(T.panel(spark, sf), "nightlight")
    out = P.keep_valid(P.keep_valid(out, "gdp_per_capita", nodata=100000.0), "elec_kwh")
    return out.select("grid_id", "year", "month", "nightlight", "gdp_per_capita")


@query(
    "log_transforms",
    """SELECT grid_id, year, month, ln(elec_kwh) AS ln_elec_kwh, ln(elec_kwh + 1) AS ln1p_elec_kwh,
    ln(population + 1) AS population_log, ln(gdp_per_capita) AS gdp_log FROM panel""",
    "ln_elec_kwh ln1p_elec_kwh population_log gdp_log",
)
def log_transforms(spark, sf):
    return T.panel(spark, sf).select(
        "grid_id", "year", "month",
        F.log("elec_kwh").alias("ln_elec_kwh"),
        F.log1p("elec_kwh").alias("ln1p_elec_kwh"),
        F.log1p("population").alias("population_log"),
        F.log("gdp_per_capita").alias("gdp_log"),
    )


@query(
    "month_labels",
    """SELECT DISTINCT year, month, printf('%d_%02d', year, month) AS year_month,
    printf('%d%02d', year, month) AS compact FROM panel""",
)
def month_labels(spark, sf):
    months = T.table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")
    )
    return months.distinct().withColumns({"year_month": month_label(), "compact": compact_month_label()})


@query(
    "cyclic_months",
    """SELECT grid_id, year, month, sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos
    FROM panel""",
    "month_sin month_cos",
)
def cyclic_months(spark, sf):
    sin, cos = cyclic_month(F.col("month"))
    return T.panel(spark, sf).select("grid_id", "year", "month", sin.alias("month_sin"), cos.alias("month_cos"))


_SPLIT = "CASE WHEN year <= 1999 THEN 'train' WHEN year = 2000 THEN 'validation' WHEN year = 2001 THEN 'test' END"


@query("temporal_split", f"SELECT grid_id, year, month, elec_kwh, {_SPLIT} AS split FROM panel")
def temporal_split(spark, sf):
    return P.temporal_split(T.panel(spark, sf).select("grid_id", "year", "month", "elec_kwh"), T.YEARS)


@query("split_sizes", f"SELECT {_SPLIT} AS split, count(*) AS rows FROM panel GROUP BY 1")
def split_sizes(spark, sf):
    return P.temporal_split(T.panel(spark, sf), T.YEARS).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "unit_and_zone_shift",
    """SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS local_day,
    CAST(hour(ts + INTERVAL 8 HOUR) AS INT) AS local_hour, value + 273.15 - 273.15 AS celsius FROM events""",
    "celsius",
)
def unit_and_zone_shift(spark, sf):
    local = shift_hours(F.col("ts"), 8)
    return T.table(spark, sf, "events").select(
        "event_id",
        F.to_date(local).alias("local_day"),
        F.hour(local).alias("local_hour"),
        (F.col("value") + 273.15 - 273.15).alias("celsius"),
    )


@query(
    "daily_max",
    "SELECT user_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, max(value) AS daily_max FROM events GROUP BY 1, 2",
)
def daily_max(spark, sf):
    return TS.local_daily_max(T.table(spark, sf, "events"), ["user_id"], "ts", F.col("value"))


_VALUE_COUNTS = """count(*) FILTER (WHERE daily_max >= 0 AND daily_max < 25) AS days_in_0_25,
  count(*) FILTER (WHERE daily_max >= 25 AND daily_max < 50) AS days_in_25_50,
  count(*) FILTER (WHERE daily_max >= 50 AND daily_max < 100) AS days_in_50_100,
  count(*) FILTER (WHERE daily_max >= 100) AS days_in_100_plus"""


@query(
    "daily_max_bins",
    f"""SELECT user_id, CAST(year(day) AS INT) AS year, CAST(month(day) AS INT) AS month, {_VALUE_COUNTS} FROM (
    SELECT user_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, max(value) AS daily_max FROM events GROUP BY 1, 2)
    GROUP BY 1, 2, 3""",
)
def daily_max_bins(spark, sf):
    return TS.monthly_bin_counts(daily_max(spark, sf), ["user_id"], bins=T.VALUE_BINS)


@query(
    "daily_max_bins_strict_month",
    f"""SELECT user_id, CAST(year(day) AS INT) AS year, CAST(month(day) AS INT) AS month, {_VALUE_COUNTS} FROM (
    SELECT user_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, max(value) AS daily_max FROM events
    WHERE month(ts) = month(ts + INTERVAL 8 HOUR) GROUP BY 1, 2) GROUP BY 1, 2, 3""",
)
def daily_max_bins_strict_month(spark, sf):
    day = TS.local_daily_max(T.table(spark, sf, "events"), ["user_id"], "ts", F.col("value"), strict_month=True)
    return TS.monthly_bin_counts(day, ["user_id"], bins=T.VALUE_BINS)


@query("temperature_day_bins", "SELECT * FROM days")
def temperature_day_bins(spark, sf):
    return T.days(spark, sf)


_ALL = " + ".join(T.DAY_NAMES)


def _family(parts):
    return " + ".join(d for d in T.DAY_NAMES if any(p in d for p in parts))


_COLD, _HOT, _MID = (_family(p) for p in (TS.COLD, TS.HOT, TS.MODERATE))
_ENTROPY = " + ".join(
    f"(CASE WHEN {d} = 0 THEN 1e-6 ELSE {d} / (t + 1e-6) END) * ln(CASE WHEN {d} = 0 THEN 1e-6 ELSE {d} / (t + 1e-6) END)"
    for d in T.DAY_NAMES
)


@query(
    "temp_aggregates",
    f"""SELECT grid_id, year, month, CAST(t AS DOUBLE) AS total_days,
    CAST({_COLD} AS DOUBLE) AS extreme_cold_days, ({_COLD}) / (t + 1e-6) AS extreme_cold_share,
    CAST({_HOT} AS DOUBLE) AS extreme_hot_days, ({_HOT}) / (t + 1e-6) AS extreme_hot_share,
    CAST({_MID} AS DOUBLE) AS moderate_temp_days, ({_MID}) / (t + 1e-6) AS moderate_temp_share,
    -({_ENTROPY}) AS temperature_entropy FROM (SELECT *, {_ALL} AS t FROM days)""",
    "extreme_cold_share extreme_hot_share moderate_temp_share temperature_entropy",
)
def temp_aggregates(spark, sf):
    return TS.temperature_aggregates(T.days(spark, sf)).drop(*T.DAY_NAMES)


def _ind(parts, suffix=""):
    return " + ".join(f"days_in_{p}{suffix}" for p in parts)


@query(
    "temperature_indicators",
    "SELECT grid_id, year, month, "
    + ", ".join(
        f"{_ind(p)} AS {n}_days, {_ind(p, '_x_canopy')} AS {'cold_days_x_canopy' if n == 'cold' else n + '_x_canopy'}"
        for n, p in TS.INDICATORS.items()
    )
    + " FROM grid_panel",
    "extreme_heat_x_canopy high_temp_x_canopy moderate_temp_x_canopy cold_days_x_canopy",
)
def temperature_indicators(spark, sf):
    keys = ["grid_id", "year", "month"]
    joined = T.panel(spark, sf).select(*keys, "canopy_share").join(T.days(spark, sf), keys, "left")
    out = TS.temperature_indicators(P.add_canopy_products(joined))
    crossed = ["cold_days_x_canopy" if n == "cold" else f"{n}_x_canopy" for n in TS.INDICATORS]
    return out.select(*keys, *[f"{n}_days" for n in TS.INDICATORS], *crossed)


@query(
    "humidity_heat_products",
    f"""SELECT grid_id, year, month, CAST(h AS INT) AS high_humidity, hot * h AS high_temp_high_humid,
    canopy_share * hot * h AS canopy_high_temp_humid FROM (
    SELECT *, CASE WHEN rhu >= 70 THEN 1 ELSE 0 END AS h, {_ind(TS.INDICATORS['high_temp'])} AS hot FROM grid_panel)""",
    "canopy_high_temp_humid",
)
def humidity_heat_products(spark, sf):
    keys = ["grid_id", "year", "month"]
    joined = T.panel(spark, sf).select(*keys, "canopy_share", "rhu").join(T.days(spark, sf), keys, "left")
    out = TS.humidity_heat_products(TS.temperature_indicators(P.add_canopy_products(joined)))
    return out.select(*keys, "high_humidity", "high_temp_high_humid", "canopy_high_temp_humid")


@query(
    "annual_city_summary",
    f"""SELECT year, city_name, province, avg(canopy_share) AS canopy_share, avg(ln_elec_kwh) AS ln_elec_kwh,
    CAST(sum({_HOT}) AS BIGINT) AS high_temp_days FROM grid_panel WHERE year IN (1996, 1998, 2000) GROUP BY 1, 2, 3""",
    "canopy_share ln_elec_kwh",
)
def annual_city_summary(spark, sf):
    hot = [d for d in T.DAY_NAMES if any(p in d for p in TS.HOT)]
    chosen = T.grid_panel(spark, sf).filter(F.col("year").isin(1996, 1998, 2000))
    return R.annual_summary(chosen, ["city_name", "province"], hot)


@query(
    "entity_counts",
    """SELECT 'rows' AS level, count(*) AS n FROM panel UNION ALL SELECT 'grid_id', count(DISTINCT grid_id) FROM panel
    UNION ALL SELECT 'city_name', count(DISTINCT city_name) FROM panel JOIN cities USING (grid_id)
    UNION ALL SELECT 'province', count(DISTINCT province) FROM panel JOIN cities USING (grid_id)""",
)
def entity_counts(spark, sf):
    joined = T.panel(spark, sf).select("grid_id").join(T.cities(spark, sf), "grid_id", "left")
    return R.entity_counts(joined, ["grid_id", "city_name", "province"])


@query(
    "complete_years",
    """SELECT * FROM (SELECT CAST(year(day) AS INT) AS year, count(*) AS rows FROM daily WHERE year(day) IN (
    SELECT year(day) FROM daily GROUP BY 1 HAVING count(DISTINCT month(day)) = 12) GROUP BY 1)""",
)
def complete_years(spark, sf):
    full = TS.keep_complete_years(T.daily(spark, sf), "day")
    return full.groupBy("year").agg(F.count(F.lit(1)).alias("rows"))


