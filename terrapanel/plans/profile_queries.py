"""Profiles, quality checks and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.functions.scalars import coerce_numeric, infinity_to_null, literal_map
from terrapanel.operators import panel as P
from terrapanel.operators import profile as PR
from terrapanel.operators import quality as Q
from terrapanel.operators import sampling as S
from terrapanel.plans import tables as T
from terrapanel.plans.panel_queries import integrate_star_left_join
from terrapanel.plans.registry import query
from terrapanel.session import checkpointed

_RANGE = ["elec_kwh", "canopy_share", "gdp_per_capita", "population", "nightlight", "prec", "rhu"]


def _per(sql: str, columns=_RANGE, source: str = "panel") -> str:
    return " UNION ALL ".join(f"SELECT {sql.format(c=c)} FROM {source}" for c in columns)


@query(
    "missing_profile",
    """, sp AS (SELECT * FROM orders_panel),
    an AS (SELECT grid_id, year, min(canopy_share) AS canopy_share FROM sp GROUP BY 1, 2),
    j AS (SELECT s.rhu, s.prec, s.nightlight, s.population, s.gdp_per_capita, a.canopy_share
      FROM panel b LEFT JOIN sp s ON b.grid_id = s.grid_id AND b.year = s.year AND b.month = s.month
      LEFT JOIN an a ON b.grid_id = a.grid_id AND b.year = a.year)
    SELECT * FROM ("""
    + _per(
        "'{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
        "count(*) FILTER (WHERE {c} IS NULL) * CAST(100 AS DOUBLE) / count(*) AS null_pct",
        ["rhu", "prec", "nightlight", "population", "gdp_per_capita", "canopy_share"], "j",
    )
    + ") WHERE null_count > 0",
    "null_pct",
)
def missing_profile(spark, sf):
    return PR.missing_profile(integrate_star_left_join(spark, sf))


@query(
    "range_profile",
    _per(
        "'{c}' AS variable, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS mean, "
        "stddev_samp({c}) AS std, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, "
        "quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75"
    ),
    "min max mean std q25 q75", 6,
)
def range_profile(spark, sf):
    return PR.range_profile(T.stored_panel(spark, sf), _RANGE)


@query(
    "summary_table",
    _per(
        "'{c}' AS variable, count({c}) AS n, CAST(max({c}) AS DOUBLE) AS max, CAST(min({c}) AS DOUBLE) AS min, "
        "avg({c}) AS mean, stddev_samp({c}) AS sd, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, "
        "quantile_cont(CAST({c} AS DOUBLE), 0.25) AS p25, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS p75"
    ),
    "max min mean sd median p25 p75", 6,
)
def summary_table(spark, sf):
    return PR.summary_table(T.stored_panel(spark, sf).select(*_RANGE))


@query(
    "coverage_time",
    """SELECT min(year) AS first_year, max(year) AS last_year,
    (SELECT string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) FROM (SELECT DISTINCT month AS m FROM panel)) AS months,
    count(DISTINCT year * 100 + month) AS year_months, count(*) AS rows FROM panel""",
)
def coverage_time(spark, sf):
    return PR.time_coverage(T.panel(spark, sf))


@query("rows_per_year", "SELECT year, count(*) AS rows FROM panel GROUP BY 1")
def rows_per_year(spark, sf):
    return PR.rows_per(T.panel(spark, sf), "year")


@query(
    "coverage_entity",
    """SELECT count(*) AS unique_grid_id, avg(n) AS rows_mean, stddev_samp(n) AS rows_std,
    (SELECT count(DISTINCT city_name) FROM panel JOIN cities USING (grid_id)) AS unique_city_name,
    (SELECT count(DISTINCT province) FROM panel JOIN cities USING (grid_id)) AS unique_province
    FROM (SELECT grid_id, count(*) AS n FROM panel GROUP BY 1)""",
    "rows_mean rows_std",
)
def coverage_entity(spark, sf):
    joined = T.panel(spark, sf).select("grid_id").join(T.cities(spark, sf), "grid_id", "left")
    return PR.entity_coverage(joined, "grid_id", ["city_name", "province"])


@query(
    "group_size_range",
    """SELECT min(n) AS min_rows, max(n) AS max_rows, count(*) AS groups FROM (
    SELECT city_name, count(*) AS n FROM panel JOIN cities USING (grid_id) GROUP BY 1)""",
)
def group_size_range(spark, sf):
    joined = T.panel(spark, sf).select("grid_id").join(T.cities(spark, sf), "grid_id", "left")
    return PR.group_size_range(joined, "city_name")


_TOTAL_DAYS = " + ".join(T.DAY_NAMES)


@query(
    "rule_violations",
    f""", v AS (SELECT CASE WHEN month = 1 THEN 0 ELSE elec_kwh - 20000 * month END AS e, gdp_per_capita,
      {_TOTAL_DAYS} AS t FROM grid_panel)
    SELECT 'negative_elec' AS rule, count(*) FILTER (WHERE e < 0) AS violations FROM v UNION ALL
    SELECT 'zero_elec_high_gdp', count(*) FILTER (WHERE e = 0 AND gdp_per_capita > (
      SELECT quantile_cont(gdp_per_capita, 0.75) FROM panel)) FROM v UNION ALL
    SELECT 'unusual_bin_sum', count(*) FILTER (WHERE t < 2 OR t > 9) FROM v""",
)
def rule_violations(spark, sf):
    keys = ["grid_id", "year", "month"]
    joined = T.panel(spark, sf).select(*keys, "elec_kwh", "gdp_per_capita").join(T.days(spark, sf), keys, "left")
    shifted = joined.withColumn(
        "elec_kwh", F.when(F.col("month") == 1, 0.0).otherwise(F.col("elec_kwh") - 20000 * F.col("month"))
    )
    return PR.rule_violations(checkpointed(shifted), low_days=2, high_days=9)


@query(
    "monthly_profile",
    "SELECT month, avg(prec) AS mean, stddev_samp(prec) AS std FROM panel GROUP BY 1",
    "mean std",
)
def monthly_profile(spark, sf):
    return PR.monthly_profile(T.panel(spark, sf), "prec")


@query(
    "variable_summary",
    """SELECT count(*) AS rows, count(DISTINCT grid_id) AS entities, count(DISTINCT year * 100 + month) AS months,
    avg(rhu) AS mean, stddev_samp(rhu) AS std, min(rhu) AS min, max(rhu) AS max FROM panel""",
    "mean std min max",
)
def variable_summary(spark, sf):
    return PR.variable_summary(T.panel(spark, sf), "rhu")


@query(
    "value_counts",
    """SELECT 'l_returnflag' AS variable, l_returnflag AS level, count(*) AS n FROM lineitem GROUP BY 2
    UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
    UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2""",
)
def value_counts(spark, sf):
    return PR.value_counts(T.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("distinct_year_month", "SELECT DISTINCT year, month FROM panel")
def distinct_year_month(spark, sf):
    return PR.distinct_rows(T.panel(spark, sf), ["year", "month"])


_HIST = """SELECT CAST(least(floor((v - lo) / ((hi - lo) / {bins})) + 1, {bins}) AS INT) AS bin, count(*) AS n
FROM (SELECT {expr} AS v FROM panel {where}), (SELECT min({expr}) AS lo, max({expr}) AS hi FROM panel {where}) GROUP BY 1"""


@query("histogram_counts", _HIST.format(bins=50, expr="rhu", where=""))
def histogram_counts(spark, sf):
    return PR.histogram_counts(T.stored_panel(spark, sf), F.col("rhu"), 50)


@query("histogram_log10", _HIST.format(bins=30, expr="log10(population + 1)", where=""))
def histogram_log10(spark, sf):
    return PR.histogram_counts(T.stored_panel(spark, sf), F.log10(F.col("population") + 1), 30)


@query("histogram_positive", _HIST.format(bins=30, expr="canopy_share", where="WHERE canopy_share > 0"))
def histogram_positive(spark, sf):
    positive = T.stored_panel(spark, sf).filter(F.col("canopy_share") > 0)
    return PR.histogram_counts(positive, F.col("canopy_share"), 30)


_BOX = ["elec_kwh", "prec", "rhu"]


@query(
    "box_statistics",
    ", q AS ("
    + " UNION ALL ".join(
        f"SELECT year, '{c}' AS variable, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, "
        f"quantile_cont({c}, 0.75) AS q75 FROM panel GROUP BY 1" for c in _BOX
    )
    + "), v AS ("
    + " UNION ALL ".join(f"SELECT year, '{c}' AS variable, {c} AS value FROM panel" for c in _BOX)
    + """) SELECT year, variable, any_value(q25) AS q25, any_value(median) AS median, any_value(q75) AS q75,
    min(CASE WHEN value >= q25 - 1.5 * (q75 - q25) THEN value END) AS whisker_low,
    max(CASE WHEN value <= q75 + 1.5 * (q75 - q25) THEN value END) AS whisker_high,
    count(*) FILTER (WHERE value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25)) AS outliers
    FROM v JOIN q USING (year, variable) GROUP BY 1, 2""",
    "q25 median q75 whisker_low whisker_high", 6,
)
def box_statistics(spark, sf):
    return PR.box_statistics(T.stored_panel(spark, sf), _BOX)


@query(
    "mean_by_family",
    _per("'{c}' AS variable, avg({c}) AS mean", T.DAY_NAMES, "days"),
    "mean",
)
def mean_by_family(spark, sf):
    return PR.mean_by_family(T.days(spark, sf), T.DAY_NAMES)


@query(
    "unpivot_days",
    " UNION ALL ".join(
        f"SELECT grid_id, year, month, '{d}' AS variable, CAST({d} AS DOUBLE) AS value FROM days" for d in T.DAY_NAMES
    ),
)
def unpivot_days(spark, sf):
    return PR.unpivot_columns(T.days(spark, sf), T.DAY_NAMES, ["grid_id", "year", "month"])


@query(
    "outliers_to_median",
    """SELECT grid_id, year, month, CASE WHEN elec_kwh < q1 - 1.5 * (q3 - q1) OR elec_kwh > q3 + 1.5 * (q3 - q1)
    THEN m ELSE elec_kwh END AS elec_kwh FROM panel, (SELECT quantile_cont(elec_kwh, 0.25) AS q1,
    quantile_cont(elec_kwh, 0.5) AS m, quantile_cont(elec_kwh, 0.75) AS q3 FROM panel)""",
    "elec_kwh:6",
)
def outliers_to_median(spark, sf):
    return PR.replace_outliers(T.stored_panel(spark, sf), ["elec_kwh"]).select("grid_id", "year", "month", "elec_kwh")


@query(
    "informative_columns",
    """SELECT feature, true AS informative FROM (SELECT 'elec_kwh' AS feature, stddev_samp(elec_kwh) AS s FROM panel
    UNION ALL SELECT 'rhu', stddev_samp(rhu) FROM panel UNION ALL SELECT 'constant', 0.0) WHERE s > 0""",
)
def informative_columns(spark, sf):
    data = T.panel(spark, sf).select("elec_kwh", "rhu", F.lit(1.0).alias("constant"))
    return spark.createDataFrame([(c, True) for c in PR.informative_numeric(data)], "feature string, informative boolean")


# --- scalar clean-up ------------------------------------------------------------------


@query(
    "infinity_to_null",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice / l_tax END AS ratio
    FROM lineitem""",
    "ratio:4",
)
def infinity_as_null(spark, sf):
    ratio = F.when(F.col("l_tax") == 0, float("inf")).otherwise(F.try_divide("l_extendedprice", "l_tax"))
    lines = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ratio.alias("ratio"))
    return infinity_to_null(lines, ["ratio"])


@query(
    "coerce_numeric",
    "SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS level, TRY_CAST(o_orderstatus AS DOUBLE) AS status FROM orders",
)
def numbers_from_text(spark, sf):
    orders = T.table(spark, sf, "orders").select(
        "o_orderkey", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("level"), F.col("o_orderstatus").alias("status")
    )
    return coerce_numeric(orders, ["level", "status"])


@query(
    "recode_labels",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS status,
    printf('%.1f%%', CAST(o_orderkey % 7 AS DOUBLE) / 7 * 100) AS share FROM orders""",
)
def recode_labels(spark, sf):
    status = literal_map(F.col("o_orderstatus"), {"F": "finished", "O": "open"}, F.lit("other"))
    return T.table(spark, sf, "orders").select(
        "o_orderkey",
        status.alias("status"),
        F.format_string("%.1f%%", (F.col("o_orderkey") % 7).cast("double") / 7 * 100).alias("share"),
    )


# --- orderings and samples --------------------------------------------------------------


@query("first_rows", "SELECT grid_id, year, month, elec_kwh FROM panel ORDER BY grid_id, year, month LIMIT 1000")
def first_rows(spark, sf):
    return S.first_rows(T.panel(spark, sf).select("grid_id", "year", "month", "elec_kwh"), ["grid_id", "year", "month"])


@query("largest_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def largest_rows(spark, sf):
    return S.extreme_rows(T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("smallest_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5")
def smallest_rows(spark, sf):
    orders = T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return S.extreme_rows(orders, "o_totalprice", "o_orderkey", largest=False)


@query(
    "median_neighbours",
    """SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS r,
    count(*) OVER () AS n FROM orders) WHERE r BETWEEN n // 2 - 2 AND n // 2 + 2""",
)
def median_neighbours(spark, sf):
    orders = T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return S.median_neighbours(orders, "o_totalprice", "o_orderkey")


@query(
    "sample_rows",
    """, s AS (SELECT unnest([0, 1, 1000, 1001, 2000]) AS size)
    SELECT size, least(size, (SELECT count(*) FROM panel)) AS n, least(size, (SELECT count(*) FROM panel)) AS distinct_keys,
      least(size, (SELECT count(*) FROM panel)) AS in_panel, 0 AS not_in_largest FROM s""",
)
def sample_rows(spark, sf):
    """Samples of several sizes: their rows, that they are rows of the panel, and each part of the largest."""
    keys = ["grid_id", "year", "month"]
    data = T.stored_panel(spark, sf).select(*keys, "elec_kwh")
    sizes = [0, 1, 1000, 1001, 2000]
    largest = S.sample_rows(data, keys, sizes[-1]).select(*keys, F.lit(True).alias("in_largest"))
    held = data.select(*keys, F.col("elec_kwh").alias("held"))
    out = None
    for size in sizes:
        part = S.sample_rows(data, keys, size).join(held, keys, "left").join(largest, keys, "left")
        row = part.agg(
            F.lit(size).alias("size"),
            F.count(F.lit(1)).alias("n"),
            F.count_distinct(*keys).alias("distinct_keys"),
            F.count_if(F.col("held") == F.col("elec_kwh")).alias("in_panel"),
            F.count_if(F.col("in_largest").isNull()).cast("int").alias("not_in_largest"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("sample_fraction", "SELECT true AS near_share, count(*) AS in_larger_or_out FROM panel")
def sample_fraction(spark, sf):
    """A fifth of the panel is near its share, and every row of it is in the sample of two fifths."""
    keys = ["grid_id", "year", "month"]
    data = T.stored_panel(spark, sf).select(*keys)
    small = S.sample_fraction(data, keys, 20).withColumn("small", F.lit(True))
    large = S.sample_fraction(data, keys, 40).withColumn("large", F.lit(True))
    joined = data.join(small, keys, "left").join(large, keys, "left")
    return joined.agg(
        (F.abs(F.count("small") / F.count(F.lit(1)) - 0.2) < 0.1).alias("near_share"),
        F.count_if(F.col("small").isNull() | F.col("large")).alias("in_larger_or_out"),
    )


@query(
    "forward_fill",
    """SELECT o_orderkey, last_value(p IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS priority
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS p FROM orders)""",
)
def forward_fill(spark, sf):
    sparse = T.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("priority")
    )
    return S.forward_fill(sparse, "o_orderkey", ["priority"], chunk=1000)


# --- quality checks ---------------------------------------------------------------------

_BOUNDS = {"south": 18.0, "north": 55.0, "west": 73.0, "east": 135.0}


@query(
    "extent_check",
    """SELECT edge, actual, expected, abs(actual - expected) <= 1.0 AS passed FROM (
    SELECT 'south' AS edge, min(lat) AS actual, CAST(18 AS DOUBLE) AS expected FROM places UNION ALL
    SELECT 'north', max(lat), 55 FROM places UNION ALL SELECT 'west', min(lon), 73 FROM places UNION ALL
    SELECT 'east', max(lon), 135 FROM places)""",
)
def extent_check(spark, sf):
    return Q.extent_check(T.places(spark, sf), _BOUNDS)


@query(
    "temporal_completeness",
    """SELECT CAST(y AS INT) AS year, coalesce(hours, 0) AS hours, CAST(h AS INT) AS expected_hours,
    coalesce(hours, 0) >= h * 0.95 AS passed FROM (VALUES (2023, 8760), (2024, 8784)) s(y, h) LEFT JOIN (
    SELECT year(ts) AS year, count(DISTINCT date_trunc('hour', ts)) AS hours FROM events GROUP BY 1) e ON s.y = e.year""",
)
def temporal_completeness(spark, sf):
    return Q.temporal_completeness(T.table(spark, sf, "events"), "ts", [2023, 2024])


@query(
    "value_quality",
    """SELECT event_type, variable, n * CAST(100 AS DOUBLE) / c AS null_pct, lo AS min, hi AS max,
    n * 100.0 / c <= 5 AND lo >= 0 AND hi <= 500 AS passed FROM (SELECT event_type, 'value' AS variable, count(*) AS c,
    count(*) FILTER (WHERE value IS NULL) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)""",
)
def value_quality(spark, sf):
    return Q.value_quality(T.table(spark, sf, "events"), {"value": (0.0, 500.0)}, by=["event_type"])


@query(
    "quality_report",
    """, e AS (SELECT year(ts) AS year, count(DISTINCT date_trunc('hour', ts)) AS hours, count(*) AS n,
      count(*) FILTER (WHERE value IS NULL) AS nul, min(value) AS lo, max(value) AS hi,
      min(18 + user_id % 38) AS s, max(18 + user_id % 38) AS nn, min(73 + user_id % 63) AS w, max(73 + user_id % 63) AS ea
      FROM events GROUP BY 1),
    t AS (SELECT CAST(y AS INT) AS year, h, e.* EXCLUDE (year), e.year IS NULL AS absent
      FROM (VALUES (2023, 8760), (2024, 8784)) s(y, h) LEFT JOIN e ON s.y = e.year)
    SELECT year, 'file_exists' AS "check", NOT absent AS passed FROM t UNION ALL
    SELECT year, 'structure', true FROM t UNION ALL
    SELECT year, 'spatial_coverage', coalesce(abs(s - 18) <= 1 AND abs(nn - 55) <= 1 AND abs(w - 73) <= 1
      AND abs(ea - 135) <= 1, false) FROM t UNION ALL
    SELECT year, 'temporal_coverage', coalesce(hours >= h * 0.95, false) FROM t UNION ALL
    SELECT year, 'quality_value', coalesce(nul * 100.0 / n <= 5 AND lo >= 0 AND hi <= 500, false) FROM t""",
)
def quality_report(spark, sf):
    u = F.col("user_id")
    events = T.table(spark, sf, "events").withColumns({"lon": F.lit(73) + u % 63, "lat": F.lit(18) + u % 38})
    report = Q.full_report(events.withColumns({"lon": F.col("lon").cast("double"), "lat": F.col("lat").cast("double")}),
                           "ts", [2023, 2024], ["ts", "value"], _BOUNDS, {"value": (0.0, 500.0)})
    return report.select("year", "check", "passed")


_MANIFEST = """, expected AS (SELECT c_nationkey AS record, c_name AS file, c_custkey % 97 + 10 AS size FROM customer),
actual AS (SELECT c_nationkey AS record, c_name AS file, CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE c_custkey % 97 + 10 END
  AS size FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)),
m AS (SELECT e.*, a.size AS actual_size, CASE WHEN a.size IS NULL THEN 'missing' WHEN a.size <> e.size THEN 'corrupt'
  ELSE 'valid' END AS state FROM expected e LEFT JOIN actual a USING (record, file))
"""


def _manifest(spark, sf):
    k = F.col("c_custkey")
    files = T.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("record"), F.col("c_name").alias("file"), (k % 97 + 10).alias("size"), k
    )
    ordered = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    actual = files.join(ordered, "c_custkey", "left_semi").withColumn("size", F.when(k % 5 == 0, 3).otherwise(F.col("size")))
    return Q.reconcile_manifest(files.drop("c_custkey"), actual)


@query("reconcile_manifest", _MANIFEST + "SELECT * FROM m")
def reconcile_manifest(spark, sf):
    return _manifest(spark, sf)


@query(
    "bytes_needed",
    _MANIFEST + """SELECT record, count(*) FILTER (WHERE state <> 'valid') AS files_needed,
    CAST(coalesce(sum(CASE WHEN state <> 'valid' THEN size END), 0) AS BIGINT) AS bytes_needed FROM m GROUP BY 1""",
)
def bytes_needed(spark, sf):
    return Q.bytes_needed(_manifest(spark, sf))


@query(
    "first_valid_rows",
    "SELECT grid_id, year, month, canopy_share FROM panel WHERE canopy_share >= 0 AND grid_id IN (SELECT grid_id FROM cities)",
)
def first_valid_rows(spark, sf):
    kept = P.keep_valid(T.panel(spark, sf).select("grid_id", "year", "month", "canopy_share"), "canopy_share")
    return kept.join(T.cities(spark, sf).select("grid_id"), "grid_id", "left_semi")
