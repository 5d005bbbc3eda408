"""Queries of the plain operators: structure, columns, metadata, checks and modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.operators import encoding as E
from terrapanel.operators import panel as P
from terrapanel.operators import profile as PR
from terrapanel.operators import quality as Q
from terrapanel.operators.quantiles import modes
from terrapanel.plans import feature_queries as FQ
from terrapanel.plans import tables as T
from terrapanel.plans.registry import query
from terrapanel.sources.sinks import metadata_row

KEYS = ["grid_id", "year", "month"]


def _each(columns, row: str) -> str:
    return " UNION ALL ".join(row.format(c=c) for c in columns)


@query(
    "panel_metadata",
    _each(
        T.MEASURES,
        "SELECT count(*) AS total_observations, '{c}' AS measure, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
        "avg({c}) AS mean, stddev_samp({c}) AS std, count({c}) AS count FROM panel",
    ),
    "min max mean:5 std:5",
)
def panel_metadata(spark, sf):
    """The metadata row, one line a measure."""
    row = metadata_row(T.panel(spark, sf), T.MEASURES)
    lines = F.array(*[F.struct(F.lit(c).alias("measure"), *[F.col(f"`{c}`.{s}").alias(s) for s in ("min", "max", "mean", "std", "count")]) for c in T.MEASURES])
    return row.select("total_observations", F.inline(lines))


_CROSSES = [f"{a}_x_{b}" for a, b in E.CATEGORY_CROSSES]


@query(
    "category_cross_dummies",
    f", {FQ._CATS.format(source='panel')}, x AS (SELECT {FQ._CROSS} FROM cat) "
    + _each(_CROSSES, "SELECT '{c}_' || {c} AS dummy, count(*) AS n FROM x GROUP BY 1"),
)
def category_cross_dummies(spark, sf):
    """How often each dummy of the eight category crosses is set."""
    crossed = E.category_crosses(FQ._categories(spark, sf)).select(*_CROSSES)
    encoder = E.OneHot(_CROSSES, drop_source=True).fit(crossed)
    dummies = encoder.transform(crossed)
    sums = dummies.agg(F.array(*[F.struct(F.lit(c).alias("dummy"), F.sum(f"`{c}`").alias("n")) for c in dummies.columns]).alias("r"))
    return sums.select(F.inline("r"))


@query(
    "redundant_columns_dropped",
    f", {FQ._CATS.format(source='panel')} SELECT unnest(['canopy_share', 'elec_kwh', 'prec', 'rhu']) AS column_name, count(*) AS n FROM cat GROUP BY 1",
)
def redundant_columns_dropped(spark, sf):
    """Rows by column that are left once the category columns, and all else but four measures, are gone."""
    kept = E.drop_redundant(FQ._categories(spark, sf)).drop(*KEYS, "population", "gdp_per_capita", "nightlight")
    lines = [F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n")) for c in sorted(kept.columns)]
    return kept.agg(F.array(*lines).alias("r")).select(F.inline("r"))


_GRID_PREDICTORS = [
    "year", "month", "rhu", "prec", "canopy_share", "population", "gdp_per_capita", "nightlight", *T.DAY_NAMES,
    *[f"{d}_x_canopy" for d in T.DAY_NAMES], "lon", "lat",
]


@query("predictor_means", _each(_GRID_PREDICTORS, "SELECT '{c}' AS feature, avg({c}) AS mean FROM grid_panel"), "mean:6")
def predictor_means(spark, sf):
    """Mean of every predictor of the grid panel: neither targets nor ids nor map coordinates."""
    df = T.grid_panel(spark, sf)
    return PR.mean_by_family(df, PR.predictor_columns(df, "grid")).withColumnRenamed("variable", "feature")


@query(
    "renamed_city_counts",
    "SELECT city_name, year, month, count(grid_id) AS grid_count FROM panel JOIN cities USING (grid_id) GROUP BY 1, 2, 3",
)
def renamed_city_counts(spark, sf):
    joined = T.panel(spark, sf).join(T.cities(spark, sf).select("grid_id", "city_name"), "grid_id")
    counted = joined.groupBy("city_name", "year", "month").agg(F.count("grid_id").alias("grid_id"))
    return P.rename_columns(counted, {"grid_id": "grid_count", "ADM2_EN": "city_name"})


@query(
    "column_sets",
    """SELECT 'shared' AS side, c AS column_name, n FROM (SELECT unnest(['elec_kwh', 'grid_id', 'month', 'rhu', 'year']) AS c,
      count(*) AS n FROM panel WHERE year <= 1999 GROUP BY 1)
    UNION ALL SELECT 'first_only', 'prec', count(prec) FROM panel WHERE year <= 1999
    UNION ALL SELECT 'second_only', 'nightlight', count(nightlight) FROM panel WHERE year = 2000""",
)
def column_sets(spark, sf):
    """Columns that two splits share or lack, with the number of values in the split that has them."""
    panel = T.stored_panel(spark, sf)
    train = panel.filter("year <= 1999").select(*KEYS, "elec_kwh", "rhu", "prec")
    other = panel.filter("year = 2000").select(*KEYS, "elec_kwh", "rhu", "nightlight")
    shared, first, second = PR.shared_columns(train, other)
    out = None
    for side, names, df in (("shared", shared, train), ("first_only", first, train), ("second_only", second, other)):
        lines = [F.struct(F.lit(side).alias("side"), F.lit(c).alias("column_name"), F.count(c).alias("n")) for c in names]
        part = df.agg(F.array(*lines).alias("r")).select(F.inline("r"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "required_columns",
    """SELECT 'events' AS source, count(*) AS rows, true AS passed, 'all required columns present' AS message FROM events
    UNION ALL SELECT 'places', count(*), false, 'missing: time, t2m' FROM places""",
)
def required_columns(spark, sf):
    out = None
    for name, df, needed in (
        ("events", T.table(spark, sf, "events"), ["ts", "value"]), ("places", T.places(spark, sf), ["lon", "time", "lat", "t2m"]),
    ):
        rows = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("source", F.lit(name))
        part = rows.crossJoin(Q.required_columns(df, needed)).select("source", "rows", "passed", "message")  # one row each
        out = part if out is None else out.unionByName(part)
    return out


_STRUCTURE = [
    ("temperature_bins", 12), ("temperature_interactions", 12), ("climate_variables", 2), ("socioeconomic_variables", 3),
    ("canopy_variables", 1), ("spatial_variables", 6), ("temporal_variables", 2), ("target_variables", 2),
]


@query(
    "dataset_structure",
    "SELECT g AS column_group, n AS n_columns, (SELECT count(*) FROM grid_panel) AS total_rows, CAST(40 AS BIGINT) AS total_columns FROM (VALUES "
    + ", ".join(f"('{g}', CAST({n} AS BIGINT))" for g, n in _STRUCTURE)
    + ") s(g, n)",
)
def dataset_structure(spark, sf):
    return PR.dataset_structure(T.grid_panel(spark, sf))


_VALIDATED = ["rhu", "prec", "canopy_share", "population"]


@query(
    "feature_validation",
    """, sp AS (SELECT s.rhu, s.prec, s.canopy_share, s.population FROM panel b LEFT JOIN orders_panel s USING (grid_id, year, month)),
    t AS (SELECT count(*) AS n FROM sp)
    SELECT 'group' AS part, 'climate_raw' AS name, CAST(2 AS DOUBLE) AS value UNION ALL SELECT 'group', 'canopy', 1
    UNION ALL SELECT 'group', 'socioeconomic_raw', 1 UNION ALL """
    + _each(_VALIDATED, "SELECT 'missing', '{c}', CAST(count(*) - count({c}) AS DOUBLE) FROM sp HAVING count(*) > count({c})")
    + " UNION ALL "
    + _each(_VALIDATED, "SELECT 'min', '{c}', CAST(min({c}) AS DOUBLE) FROM sp UNION ALL SELECT 'max', '{c}', CAST(max({c}) AS DOUBLE) FROM sp"),
)
def feature_validation(spark, sf):
    """Group sizes, missing values and extremes of a table with gaps, as (part, name, value)."""
    keys = ["grid_id", "year", "month"]
    gaps = T.panel(spark, sf).select(*keys).join(T.orders_panel(spark, sf), keys, "left").select(*_VALIDATED)
    groups, missing, ranges = Q.feature_validation(gaps, _VALIDATED)
    value = lambda part, name, v: (F.lit(part).alias("part"), F.col(name).alias("name"), F.col(v).cast("double").alias("value"))
    out = groups.select(*value("group", "column_group", "n_columns"))
    out = out.unionByName(missing.select(*value("missing", "variable", "null_count")))
    for side in ("min", "max"):
        out = out.unionByName(ranges.select(*value(side, "variable", side)))
    return out


_MODES = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"]


@query(
    "modes",
    _each(
        _MODES,
        "SELECT '{c}' AS column_name, (SELECT CAST({c} AS VARCHAR) FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS value",
    ),
)
def column_modes(spark, sf):
    """Most frequent value of several columns, the smallest on ties."""
    found = modes(T.table(spark, sf, "lineitem"), _MODES)
    return found.select("column_name", "value")
