"""The regression family of the panel study, and single fits checked in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.operators import fixed_effects as FE
from terrapanel.operators.encoding import QuantileBinner
from terrapanel.operators.panel import add_canopy_products
from terrapanel.operators.timeseries import humidity_heat_products, temperature_indicators
from terrapanel.plans import tables as T
from terrapanel.plans.registry import query
from terrapanel.session import checkpointed

KEYS = ["grid_id", "year", "month"]
EFFECTS = ["grid_id", "year", "month"]
CONTROLS = ("canopy_share", "ln_pop", "ln_light")


def _days(*names: str) -> tuple[str, ...]:
    return tuple(f"days_in_bin_{n}" for n in names)


def _crossed(*names: str) -> tuple[str, ...]:
    return tuple(f"days_in_bin_{n}_x_canopy" for n in names)


# Day bins of the models; 15 to 20 degrees is the reference bin.
ALL_BINS = ("below_neg10", "neg10_neg5", "neg5_0", "0_5", "5_10", "10_15", "20_25", "25_30", "30_35", "35_40", "40_plus")
CROSSED_BINS = ("neg10_neg5", "neg5_0", "0_5", "5_10", "10_15", "15_20", "20_25", "25_30", "30_35", "35_40", "40_plus")
SIGNIFICANT_BINS = ("0_5", "25_30", "30_35", "35_40")
WARM_BINS = ("20_25", "25_30", "30_35", "35_40", "40_plus")
HOT_BINS = ("25_30", "30_35", "35_40", "40_plus")
_HOT_PAIRS = [(d, "canopy_share") for d in _days(*HOT_BINS)]
_DETAILED = (*_days(*HOT_BINS), *[f"{a}:{b}" for a, b in _HOT_PAIRS], *CONTROLS)

#: The ten models: three of rising size, three of aggregated days, two by canopy level, two by humidity.
MODELS = {
    "model_1": FE.Model((*_days(*ALL_BINS), *CONTROLS)),
    "model_2": FE.Model((*_days(*ALL_BINS), *_crossed(*SIGNIFICANT_BINS), *CONTROLS)),
    "model_3": FE.Model((*_days(*ALL_BINS), *_crossed(*CROSSED_BINS), *CONTROLS)),
    "simple_1": FE.Model(("extreme_heat_days", "extreme_heat_x_canopy", *CONTROLS)),
    "simple_2": FE.Model(("high_temp_days", "high_temp_x_canopy", *CONTROLS)),
    "simple_3": FE.Model((
        "cold_days", "moderate_temp_days", "high_temp_days", "moderate_temp_x_canopy", "high_temp_x_canopy", *CONTROLS,
        "cold_days_x_canopy",
    )),
    "low_canopy": FE.Model((*_days(*WARM_BINS), *CONTROLS), "low_canopy"),
    "high_canopy": FE.Model((*_days(*WARM_BINS), *CONTROLS), "high_canopy"),
    "high_humidity": FE.Model(_DETAILED, "high_humidity"),
    "low_humidity": FE.Model(_DETAILED, "low_humidity"),
}


def regression_table(panel):
    """Columns of all ten models, from a panel with day counts, and the rows of each subset."""
    df = humidity_heat_products(temperature_indicators(add_canopy_products(panel)))
    df = df.withColumns({"ln_elec_kwh": F.log("elec_kwh"), "ln_pop": F.log1p("population"), "ln_light": F.log1p("nightlight")})
    df, _ = FE.interaction(df, _HOT_PAIRS)
    level = QuantileBinner("canopy_share", ("Low", "Medium", "High")).fit(panel).expression()
    subsets = {
        "low_canopy": level == "Low", "high_canopy": level == "High",
        "high_humidity": F.col("high_humidity") == 1, "low_humidity": F.col("high_humidity") == 0,
    }
    return df, subsets


def fit_regressions(panel, **options) -> dict[str, FE.FixedEffectsFit]:
    df, subsets = regression_table(panel)
    return FE.fit_family(df, "ln_elec_kwh", MODELS, EFFECTS, subsets, **options)


def located_panel(spark, sf):
    """The panel with day counts and coordinates, written once: cut points and models read it."""
    joined = T.panel(spark, sf).join(T.days(spark, sf), KEYS, "left")
    return checkpointed(joined.join(T.cities(spark, sf).select("grid_id", "city_id", "lon", "lat"), "grid_id"))


@query("fe_ols_three_way")
def fe_ols_three_way(spark, sf):
    """The ten regressions of the study with grid, year and month absorbed and errors over 100 km."""
    return FE.coefficient_table(spark, fit_regressions(located_panel(spark, sf), vcov="conley"))


# Alternating subtraction of group means, a fixed number of rounds, for the twins in SQL.
def _swept(effects: list[str], columns: dict[str, str], rounds: int = 40) -> str:
    keep = ", ".join(dict.fromkeys(["grid_id", *effects]))
    inner = f"SELECT k, {keep}, {', '.join(columns)} FROM swept WHERE k < {rounds}"
    for e in effects:
        inner = f"SELECT k, {keep}, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY {e}) AS {c}' for c in columns)} FROM ({inner})"
    return f""", recursive swept AS (
    SELECT 0 AS k, {keep}, {', '.join(f'{v} AS {c}' for c, v in columns.items())} FROM (SELECT *, year * 100 + month AS ym FROM panel)
    UNION ALL SELECT k + 1 AS k, {keep}, {', '.join(columns)} FROM ({inner})),
    d AS (SELECT * FROM swept WHERE k = {rounds})"""


def _p_value(t: str, v: str) -> str:
    """Two-sided p of Student's t: one less twice the integral of the density from 0, by Simpson's rule."""
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    curve = f"pow(1 + ({t} * i / 2000) ** 2 / {v}, -({v} + 1) / 2)"
    front = f"exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt({v} * pi())"
    return f"1 - 2 * {front} * list_sum([({weight}) * {curve} FOR i IN range(0, 2001)]) * {t} / 6000"


_STARS = "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars"
_NEAR = "sqrt((a.lat - c.lat) ** 2 + (cos(radians((a.lat + c.lat) / 2)) * (a.lon - c.lon)) ** 2) * 111.0 <= 100"
_THREE_WAY = (
    _swept(["grid_id", "year", "month"], {"y": "ln(elec_kwh)", "a": "rhu", "b": "gdp_per_capita"})
    + f""",
    g AS (SELECT count(*) AS n, (SELECT count(DISTINCT grid_id) + count(DISTINCT year) + count(DISTINCT month) - 2 + 2 FROM panel) AS k,
      sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM d),
    f AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS b1,
      (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS b2 FROM g),
    s AS (SELECT lon, lat, sum(a * (y - b1 * a - b2 * b)) AS u, sum(b * (y - b1 * a - b2 * b)) AS w
      FROM d JOIN cities USING (grid_id), f GROUP BY 1, 2),
    m AS (SELECT sum(a.u * c.u) AS uu, sum(a.u * c.w) AS uw, sum(a.w * c.w) AS ww FROM s a JOIN s c ON {_NEAR}),
    r AS (SELECT 'rhu' AS term, b1 AS estimate, sqrt((bb * bb * uu - 2 * ab * bb * uw + ab * ab * ww) / (det * det) * (n - 1) / (n - k)) AS std_error, n - k AS v FROM f, m
      UNION ALL SELECT 'gdp_per_capita', b2, sqrt((ab * ab * uu - 2 * ab * aa * uw + aa * aa * ww) / (det * det) * (n - 1) / (n - k)), n - k FROM f, m),
    q AS (SELECT term, estimate, std_error, {_p_value("abs(estimate / std_error)", "CAST(v AS DOUBLE)")} AS p FROM r)
    SELECT *, {_STARS} FROM q"""
)


@query("fe_three_way_conley", _THREE_WAY, "estimate:13 std_error:13 p:7")
def fe_three_way_conley(spark, sf):
    """One three-way fit with errors over distance, its p and its stars."""
    df = located_panel(spark, sf).withColumn("ln_elec_kwh", F.log("elec_kwh"))
    fit = FE.fixed_effects_ols(df, "ln_elec_kwh", ["rhu", "gdp_per_capita"], EFFECTS, vcov="conley")
    return FE.coefficient_table(spark, {"m": fit}).drop("model")


_TWO_WAY = (
    _swept(["grid_id", "ym"], {"y": "ln(elec_kwh)", "a": "rhu", "b": "prec"})
    + f""",
    g AS (SELECT count(*) AS n, (SELECT count(DISTINCT (year, month)) + 2 FROM panel) AS k, sum(a * a) AS aa, sum(a * b) AS ab,
      sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM d),
    f AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS b1,
      (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS b2 FROM g),
    s AS (SELECT city_id, sum(a * (y - b1 * a - b2 * b)) AS u, sum(b * (y - b1 * a - b2 * b)) AS w
      FROM d JOIN cities USING (grid_id), f GROUP BY 1),
    m AS (SELECT sum(u * u) AS uu, sum(u * w) AS uw, sum(w * w) AS ww, count(*) AS c FROM s),
    h AS (SELECT *, (n - 1) / CAST(n - k AS DOUBLE) * c / (c - 1) AS adjust FROM f, m),
    r AS (SELECT 'rhu' AS term, b1 AS estimate, sqrt((bb * bb * uu - 2 * ab * bb * uw + ab * ab * ww) / (det * det) * adjust) AS std_error, c - 1 AS v FROM h
      UNION ALL SELECT 'prec', b2, sqrt((ab * ab * uu - 2 * ab * aa * uw + aa * aa * ww) / (det * det) * adjust), c - 1 FROM h),
    q AS (SELECT term, estimate, std_error, {_p_value("abs(estimate / std_error)", "CAST(v AS DOUBLE)")} AS p FROM r)
    SELECT *, {_STARS} FROM q"""
)


@query("fe_clustered_year_month", _TWO_WAY, "estimate:11 std_error:11 p:7")
def fe_clustered_year_month(spark, sf):
    """Grid and year-month absorbed, errors clustered by city; grids lie inside cities and do not count."""
    df = located_panel(spark, sf).withColumns({"ln_elec_kwh": F.log("elec_kwh"), "year_month": F.col("year") * 100 + F.col("month")})
    fit = FE.fixed_effects_ols(
        df, "ln_elec_kwh", ["rhu", "prec"], ["grid_id", "year_month"], vcov="cluster", cluster="city_id", count_nested=False
    )
    return FE.coefficient_table(spark, {"m": fit}).drop("model")


@query(
    "fe_dropped_terms",
    """SELECT unnest(['twice', 'per_grid']) AS term, CAST(NULL AS DOUBLE) AS estimate, CAST(NULL AS DOUBLE) AS std_error,
    CAST(NULL AS DOUBLE) AS p, '' AS stars""",
)
def fe_dropped_terms(spark, sf):
    """What a fit reports of regressors that others or an effect explain."""
    df = T.stored_panel(spark, sf).withColumns(
        {"ln_elec_kwh": F.log("elec_kwh"), "twice": F.col("rhu") * 2 - F.col("prec"), "per_grid": F.col("grid_id") % 7}
    )
    fit = FE.fixed_effects_ols(df, "ln_elec_kwh", ["rhu", "prec", "twice", "per_grid"], EFFECTS)
    return FE.coefficient_table(spark, {"m": fit}).drop("model").filter("estimate IS NULL")
