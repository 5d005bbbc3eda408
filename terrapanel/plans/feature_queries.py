"""Bins, dummies, crosses, products, imputation, and the two whole feature pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.functions.bins import (
    CANOPY_BINS_WIDE,
    CANOPY_BREAKS,
    CANOPY_LEVELS,
    HUMIDITY_BINS,
    HUMIDITY_BINS_PLAIN,
    PRECIPITATION_BINS_DAILY,
    PRECIPITATION_BINS_MONTHLY,
    bin_label,
    zero_then_breaks,
)
from terrapanel.operators import encoding as E
from terrapanel.operators.events import event_dummies, event_years
from terrapanel.operators import panel as P
from terrapanel.operators import timeseries as TS
from terrapanel.operators.rollup import rollup
from terrapanel.plans import tables as T
from terrapanel.plans.registry import query
from terrapanel.session import checkpointed

KEYS = ["grid_id", "year", "month"]
_K = "grid_id, year, month"


def _case(column: str, bins, default: str = "'unknown'") -> str:
    arms = []
    for i, b in enumerate(bins):
        cond = [] if b.low == float("-inf") else [f"{column} >= {b.low}"]
        if i < len(bins) - 1:
            cond.append(f"{column} < {b.high}")
        arms.append(f"WHEN {' AND '.join(cond)} THEN '{b.name}'")
    return f"CASE {' '.join(arms)} ELSE {default} END"


_HUM = _case("rhu", HUMIDITY_BINS)
_HUM_PLAIN = _case("rhu", HUMIDITY_BINS_PLAIN)
_PREC = _case("prec", PRECIPITATION_BINS_DAILY)
_PREC_MONTH = _case("prec", PRECIPITATION_BINS_MONTHLY)
_CANOPY = """CASE WHEN canopy_share = 0 THEN 'no_canopy' WHEN canopy_share > 0 AND canopy_share <= 0.1 THEN 'low_canopy'
 WHEN canopy_share > 0.1 AND canopy_share <= 0.3 THEN 'medium_canopy' WHEN canopy_share > 0.3 THEN 'high_canopy'
 ELSE 'unknown' END"""


def _tertile(column: str, labels, q1: str, q2: str) -> str:
    return (
        f"CASE WHEN {column} <= {q1} THEN '{labels[0]}' WHEN {column} <= {q2} THEN '{labels[1]}' "
        f"WHEN {column} > {q2} THEN '{labels[2]}' ELSE 'unknown' END"
    )


_LIGHT = """CASE WHEN nightlight = 0 THEN 'rural' WHEN nightlight > 0 AND nightlight <= nl THEN 'urban_low'
 WHEN nightlight > nl THEN 'urban_high' ELSE 'unknown' END"""
_SEASON = """CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring'
 WHEN month IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END"""
_CUTS = """cuts AS (SELECT quantile_cont(gdp_per_capita, 0.33) AS g1, quantile_cont(gdp_per_capita, 0.67) AS g2,
  quantile_cont(CAST(population AS DOUBLE), 0.33) AS p1, quantile_cont(CAST(population AS DOUBLE), 0.67) AS p2,
  quantile_cont(CASE WHEN nightlight > 0 THEN CAST(nightlight AS DOUBLE) END, 0.5) AS nl FROM panel WHERE year <= 1999)"""
_GDP = _tertile("gdp_per_capita", E.GDP_LABELS, "g1", "g2")
_POP = _tertile("population", E.POPULATION_LABELS, "p1", "p2")
_CATS = f"""{_CUTS}, cat AS (SELECT p.*, {_HUM} AS humidity_category, {_PREC} AS precipitation_category,
  {_GDP} AS gdp_category, {_POP} AS population_category, {_CANOPY} AS canopy_category, {_LIGHT} AS nightlight_category
  FROM {{source}} p, cuts)"""


def _train(df):
    return df.filter(F.col("year") <= 1999)


def _categories(spark, sf):
    """Category columns with cut points learned on the training years only."""
    panel = T.stored_panel(spark, sf)
    return E.CategoryBinner().fit(_train(panel)).transform(panel)


@query("humidity_bins", f"SELECT {_K}, {_HUM} AS humidity_category, {_HUM_PLAIN} AS humidity_plain FROM panel")
def humidity_bins(spark, sf):
    v = F.col("rhu")
    return T.panel(spark, sf).select(
        *KEYS, bin_label(v, HUMIDITY_BINS).alias("humidity_category"), bin_label(v, HUMIDITY_BINS_PLAIN).alias("humidity_plain")
    )


@query("precipitation_bins", f"SELECT {_K}, {_PREC} AS precipitation_category, {_PREC_MONTH} AS monthly FROM panel")
def precipitation_bins(spark, sf):
    v = F.col("prec")
    return T.panel(spark, sf).select(
        *KEYS,
        bin_label(v, PRECIPITATION_BINS_DAILY).alias("precipitation_category"),
        bin_label(v, PRECIPITATION_BINS_MONTHLY).alias("monthly"),
    )


@query(
    "canopy_bins",
    f"SELECT {_K}, {_CANOPY} AS canopy_category, {_case('canopy_share', CANOPY_BINS_WIDE)} AS canopy_wide FROM panel",
)
def canopy_bins(spark, sf):
    v = F.col("canopy_share")
    return T.panel(spark, sf).select(
        *KEYS,
        zero_then_breaks(v, "no_canopy", CANOPY_BREAKS, "high_canopy").alias("canopy_category"),
        bin_label(v, CANOPY_BINS_WIDE).alias("canopy_wide"),
    )


@query("tertile_bins", f", {_CUTS} SELECT {_K}, {_GDP} AS gdp_category, {_POP} AS population_category FROM panel, cuts")
def tertile_bins(spark, sf):
    df = T.stored_panel(spark, sf)
    gdp = E.QuantileBinner("gdp_per_capita", E.GDP_LABELS).fit(_train(df))
    pop = E.QuantileBinner("population", E.POPULATION_LABELS).fit(_train(df))
    return df.select(*KEYS, gdp.expression().alias("gdp_category"), pop.expression().alias("population_category"))


@query(
    "tertile_bins_per_split",
    f""", s AS (SELECT *, CASE WHEN year <= 1999 THEN 'train' WHEN year = 2000 THEN 'validation' ELSE 'test' END AS split
      FROM panel), q AS (SELECT split, quantile_cont(gdp_per_capita, 0.33) AS g1, quantile_cont(gdp_per_capita, 0.67) AS g2
      FROM s GROUP BY 1) SELECT {_K}, split, {_GDP} AS gdp_category FROM s JOIN q USING (split)""",
)
def tertile_bins_per_split(spark, sf):
    """Cut points learned anew on each split, for comparison with results made that way."""
    df = P.temporal_split(T.stored_panel(spark, sf).select(*KEYS, "gdp_per_capita"), T.YEARS)
    out = None
    for split in T.YEARS:
        part = df.filter(F.col("split") == split)
        part = E.QuantileBinner("gdp_per_capita", E.GDP_LABELS).fit(part).transform(part, "gdp_category")
        out = part if out is None else out.unionByName(part)
    return out.drop("gdp_per_capita")


@query("zero_inflated_bins", f", {_CUTS} SELECT {_K}, {_LIGHT} AS nightlight_category FROM panel, cuts")
def zero_inflated_bins(spark, sf):
    df = T.stored_panel(spark, sf)
    return E.ZeroInflatedBinner("nightlight").fit(_train(df)).transform(df, "nightlight_category").select(*KEYS, "nightlight_category")


@query(
    "canopy_level",
    f""", q AS (SELECT quantile_cont(canopy_share, 0.33) AS a, quantile_cont(canopy_share, 0.67) AS b FROM panel)
    SELECT {_K}, CASE WHEN canopy_share <= a THEN 'Low' WHEN canopy_share <= b THEN 'Medium' ELSE 'High' END AS canopy_level
    FROM panel, q""",
)
def canopy_level(spark, sf):
    df = T.stored_panel(spark, sf)
    return E.QuantileBinner("canopy_share", ("Low", "Medium", "High")).fit(df).transform(df, "canopy_level", "High").select(
        *KEYS, "canopy_level"
    )


@query(
    "season_flags",
    f"""SELECT {_K}, {_SEASON} AS season, CAST(month IN (6, 7, 8, 9) AS INT) AS cooling_season,
    CAST(month IN (12, 1, 2, 3) AS INT) AS heating_season FROM panel""",
)
def season_flags(spark, sf):
    return E.season_features(T.panel(spark, sf).select(*KEYS))


@query(
    "temporal_features",
    f"""SELECT {_K}, {_SEASON} AS season, CAST(month IN (6, 7, 8) AS INT) AS is_summer,
    CAST(month IN (12, 1, 2) AS INT) AS is_winter, CAST(month IN (1, 2, 7, 8) AS INT) AS peak_energy_month,
    year - (SELECT min(year) FROM panel) AS years_since_start, CAST(year >= 2015 AS INT) AS post_2015 FROM panel""",
)
def temporal_features(spark, sf):
    start = T.table(spark, sf, "lineitem").agg(F.min(F.year("l_shipdate"))).first()[0]
    return E.temporal_features(T.panel(spark, sf).select(*KEYS), start)


_CROSS = ", ".join(f"{a}_category || '_' || {b}_category AS {a}_x_{b}" for a, b in E.CATEGORY_CROSSES)


@query("category_cross", f", {_CATS.format(source='panel')} SELECT {_K}, {_CROSS} FROM cat")
def category_cross(spark, sf):
    return E.category_crosses(_categories(spark, sf)).select(*KEYS, *[f"{a}_x_{b}" for a, b in E.CATEGORY_CROSSES])


_LEVELS = {
    "humidity_category": [b.name for b in HUMIDITY_BINS],
    "canopy_category": sorted(CANOPY_LEVELS),
    "season": ["autumn", "spring", "summer", "winter"],
}


def _dummy(column: str, level: str, name: str) -> str:
    return f"CASE WHEN {column} = '{level}' THEN 1 ELSE 0 END AS \"{name}\""


@query(
    "one_hot",
    f", c AS (SELECT {_K}, {_HUM} AS humidity_category, {_CANOPY} AS canopy_category FROM panel) SELECT *, "
    + ", ".join(
        _dummy(c, v, f"{c.removesuffix('_category')}_{v}") for c in ("humidity_category", "canopy_category") for v in _LEVELS[c]
    )
    + " FROM c",
)
def one_hot(spark, sf):
    cats = ["humidity_category", "canopy_category"]
    df = T.panel(spark, sf).select(
        *KEYS,
        bin_label(F.col("rhu"), HUMIDITY_BINS).alias(cats[0]),
        zero_then_breaks(F.col("canopy_share"), "no_canopy", CANOPY_BREAKS, "high_canopy").alias(cats[1]),
    )
    return E.OneHot(cats, E.dummy_prefixes(cats), levels={c: _LEVELS[c] for c in cats}).transform(df)


@query(
    "one_hot_drop_first",
    f", c AS (SELECT {_K}, {_SEASON} AS season FROM panel) SELECT {_K}, "
    + ", ".join(_dummy("season", v, f"season_{v}") for v in _LEVELS["season"][1:])
    + " FROM c",
)
def one_hot_drop_first(spark, sf):
    df = E.season_features(T.panel(spark, sf).select(*KEYS)).drop("cooling_season", "heating_season")
    return E.OneHot(["season"], drop_first=True, drop_source=True).fit(df).transform(df)


# --- the whole grid pipeline ---------------------------------------------------------

_GRID_LEVELS = {
    "humidity": [b.name for b in HUMIDITY_BINS],
    "precipitation": [b.name for b in PRECIPITATION_BINS_DAILY],
    "gdp": sorted(E.GDP_LABELS),
    "population": sorted(E.POPULATION_LABELS),
    "nightlight": ["rural", "urban_high", "urban_low"],
    "canopy": sorted(CANOPY_LEVELS),
}
_GRID_DUMMIES = [_dummy(f"{p}_category", v, f"{p}_{v}") for p, vs in _GRID_LEVELS.items() for v in vs] + [
    _dummy("season", v, f"season_{v}") for v in _LEVELS["season"]
]
_t = " + ".join(T.DAY_NAMES)


def _days(parts):
    return "(" + " + ".join(d for d in T.DAY_NAMES if any(p in d for p in parts)) + ")"


_SHARES = ", ".join(
    f"{_days(p)} / (t + 1e-6) AS {n}_share"
    for n, p in (("extreme_cold", TS.COLD), ("extreme_hot", TS.HOT), ("moderate_temp", TS.MODERATE))
)
_GRID_SQL = f""", {_CATS.format(source='grid_panel')},
 f AS (SELECT *, {_SEASON} AS season, CAST(month IN (6, 7, 8, 9) AS INT) AS cooling_season,
   CAST(month IN (12, 1, 2, 3) AS INT) AS heating_season, {_t} AS t FROM cat),
 g AS (SELECT *, {_SHARES}, {", ".join(_GRID_DUMMIES)} FROM f)
SELECT {_K}, elec_kwh, cooling_season, heating_season, extreme_cold_share, extreme_hot_share, moderate_temp_share,
 {", ".join(f'"{p}_{v}"' for p, vs in {**_GRID_LEVELS, "season": _LEVELS["season"]}.items() for v in vs)},
 {", ".join(f'"{a}" * "{b}" AS {n}' for n, a, b in E.PRODUCT_RULES)} FROM g"""
_GRID_DOUBLES = [n for n, a, b in E.PRODUCT_RULES if "share" in a + b]


def engineer_grid(df, binner: E.CategoryBinner, one_hot_encoder: E.OneHot):
    """Every grid-level feature; the category columns are dropped at the end."""
    out = E.season_features(binner.transform(TS.temperature_aggregates(df)))
    return E.product_features(one_hot_encoder.transform(out))


def grid_encoder() -> E.OneHot:
    """Levels are fixed by the bin definitions, so no pass over the data is needed."""
    cats = [f"{p}_category" for p in _GRID_LEVELS] + ["season"]
    levels = {f"{p}_category": v for p, v in _GRID_LEVELS.items()} | {"season": _LEVELS["season"]}
    return E.OneHot(cats, E.dummy_prefixes(cats), drop_source=True, levels=levels)


@query("engineered_grid_features", _GRID_SQL, " ".join(["extreme_cold_share", "extreme_hot_share", "moderate_temp_share", *_GRID_DOUBLES]))
def engineered_grid_features(spark, sf):
    keys = ["grid_id", "year", "month"]
    panel = T.stored_panel(spark, sf)
    binner = E.CategoryBinner().fit(_train(panel))
    joined = panel.join(T.days(spark, sf), keys, "left")
    out = engineer_grid(joined, binner, grid_encoder())
    dummies = list(grid_encoder().names())
    return out.select(
        *KEYS, "elec_kwh", "cooling_season", "heating_season", "extreme_cold_share", "extreme_hot_share",
        "moderate_temp_share", *dummies, *[n for n, _, _ in E.PRODUCT_RULES],
    )


@query(
    "engineered_city_features",
    f""", city_month AS (SELECT city_name, year, month, sum(elec_kwh) AS elec_kwh, CAST(sum(population) AS BIGINT) AS population,
      round(avg(rhu), 9) AS rhu, round(avg(prec), 9) AS prec, round(avg(canopy_share), 9) AS canopy_share,
      round(avg(gdp_per_capita), 9) AS gdp_per_capita, round(avg(nightlight), 9) AS nightlight FROM grid_panel WHERE city_name IS NOT NULL GROUP BY 1, 2, 3),
    {_CATS.format(source='city_month').replace('FROM panel WHERE', 'FROM city_month WHERE')}
    SELECT city_name, year, month, ln(elec_kwh + 1) AS ln_elec_kwh, humidity_category, precipitation_category, gdp_category,
    population_category, nightlight_category, {_CROSS}, CASE WHEN canopy_category || '_' || gdp_category =
    'high_canopy_high_gdp' THEN 1 ELSE 0 END AS canopy_x_gdp_high_canopy_high_gdp FROM cat""",
    "ln_elec_kwh",
)
def engineered_city_features(spark, sf):
    joined = T.panel(spark, sf).join(T.cities(spark, sf).select("grid_id", "city_name"), "grid_id")
    how = {"elec_kwh": "sum", "population": "sum"} | {
        c: "mean" for c in ("rhu", "prec", "canopy_share", "gdp_per_capita", "nightlight")
    }
    city = rollup(P.require_key(joined), ["city_name", "year", "month"], how)
    # means over a few rows may differ in the last bit between engines
    city = checkpointed(city.withColumns({c: F.round(c, 9) for c in ("rhu", "prec", "canopy_share", "gdp_per_capita", "nightlight")}))
    binner = E.CategoryBinner().fit(_train(city))
    out = binner.transform(city.withColumn("ln_elec_kwh", F.log1p("elec_kwh")))
    out = E.category_crosses(out)
    levels = {"canopy_x_gdp": ["high_canopy_high_gdp"]}
    out = E.OneHot(["canopy_x_gdp"], levels=levels).transform(out)
    return out.select(
        "city_name", "year", "month", "ln_elec_kwh", "humidity_category", "precipitation_category", "gdp_category",
        "population_category", "nightlight_category", *[f"{a}_x_{b}" for a, b in E.CATEGORY_CROSSES],
        "canopy_x_gdp_high_canopy_high_gdp",
    )


@query(
    "ratio_features",
    f""", {_CATS.format(source='panel')} SELECT {_K}, elec_kwh / (population + 1) AS elec_per_capita,
    ln(1 + elec_kwh / (population + 1)) AS ln_elec_per_capita,
    elec_kwh / (gdp_per_capita * population + 1) AS elec_per_gdp, ln(1 + elec_kwh / (gdp_per_capita * population + 1)) AS
    ln_elec_per_gdp, canopy_share / (avg(canopy_share) OVER (PARTITION BY population_category) + 1) AS canopy_effectiveness
    FROM cat""",
    "elec_per_capita:6 ln_elec_per_capita elec_per_gdp ln_elec_per_gdp canopy_effectiveness",
)
def ratio_features(spark, sf):
    out = E.ratio_features(_categories(spark, sf))
    return out.select(
        *KEYS, "elec_per_capita", "ln_elec_per_capita", "elec_per_gdp", "ln_elec_per_gdp", "canopy_effectiveness"
    )


@query(
    "group_mean",
    """SELECT grid_id, year, month, canopy_share, avg(canopy_share) OVER (PARTITION BY province) AS province_mean
    FROM panel JOIN cities USING (grid_id)""",
    "province_mean",
)
def group_mean(spark, sf):
    joined = T.panel(spark, sf).join(T.cities(spark, sf).select("grid_id", "province"), "grid_id")
    return E.group_mean(joined, "province", "canopy_share", "province_mean").select(*KEYS, "canopy_share", "province_mean")


@query(
    "weighted_score",
    f"""SELECT {_K}, CASE WHEN h = 'dry' THEN 3 ELSE 0 END + CASE WHEN p = 'low' THEN 2 ELSE 0 END
    + CASE WHEN s = 'high' THEN 1 ELSE 0 END AS climate_vulnerability FROM (SELECT *, {_HUM_PLAIN} AS h,
    CASE WHEN prec < 30 THEN 'low' ELSE 'other' END AS p, CASE WHEN nightlight > 2 THEN 'high' ELSE 'low' END AS s FROM panel)""",
)
def weighted_score(spark, sf):
    df = T.panel(spark, sf).select(
        *KEYS,
        bin_label(F.col("rhu"), HUMIDITY_BINS_PLAIN).alias("h"),
        F.when(F.col("prec") < 30, "low").otherwise("other").alias("p"),
        F.when(F.col("nightlight") > 2, "high").otherwise("low").alias("s"),
    )
    return df.select(*KEYS, E.vulnerability_score("h", "p", "s").alias("climate_vulnerability"))


@query(
    "impute_median",
    """, j AS (SELECT b.grid_id, b.year, b.month, b.elec_kwh, s.rhu, s.gdp_per_capita, s.population,
      CASE WHEN s.nightlight > 0 THEN 'kept' END AS tag FROM panel b LEFT JOIN
      orders_panel s ON b.grid_id = s.grid_id AND b.year = s.year AND b.month = s.month),
    m AS (SELECT median(rhu) AS r, median(gdp_per_capita) AS g, median(CAST(population AS DOUBLE)) AS p FROM j WHERE year <= 1999)
    SELECT grid_id, year, month, elec_kwh, coalesce(rhu, r) AS rhu, coalesce(gdp_per_capita, g) AS gdp_per_capita,
    coalesce(CAST(population AS DOUBLE), p) AS population, coalesce(tag, 'missing') AS tag FROM j, m""",
    "rhu gdp_per_capita:6",
)
def impute_median(spark, sf):
    base = T.panel(spark, sf).select(*KEYS, "elec_kwh")
    gaps = T.orders_panel(spark, sf).select(*KEYS, "rhu", "gdp_per_capita", "population", "nightlight")
    df = checkpointed(base.join(gaps, KEYS, "left").withColumn("tag", F.when(F.col("nightlight") > 0, "kept")).drop("nightlight"))
    imputer = E.Imputer(exempt=("elec_kwh", *KEYS)).fit(_train(df))
    return imputer.transform(df)


@query(
    "label_codes",
    """SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INT) AS o_orderstatus,
    CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS o_orderpriority FROM orders""",
)
def label_codes(spark, sf):
    orders = T.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    early, late = orders.filter(F.col("o_orderkey") % 2 == 0), orders.filter(F.col("o_orderkey") % 2 == 1)
    codes = E.LabelCodes(["o_orderstatus", "o_orderpriority"]).fit(early, late)
    return codes.transform(early).unionByName(codes.transform(late))


@query(
    "event_study",
    """, y AS (SELECT grid_id, year, avg(canopy_share) * 100 AS lv FROM panel GROUP BY 1, 2),
    l AS (SELECT *, lag(lv) OVER w AS before, lag(year) OVER w AS last FROM y WINDOW w AS (PARTITION BY grid_id ORDER BY year)),
    e AS (SELECT grid_id, min(year) AS event_year FROM l WHERE year - last = 1 AND round(lv - before, 9) >= 5 GROUP BY 1)
    SELECT grid_id, year, month, event_year, relative_year, """
    + ", ".join(
        f"CASE WHEN relative_year = {k} THEN 1 ELSE 0 END AS event_{'m' if k < 0 else 'p'}{abs(k)}"
        for k in range(-3, 6) if k != -1
    )
    + """ FROM (SELECT p.grid_id, p.year, p.month, event_year,
      CASE WHEN event_year IS NOT NULL THEN least(greatest(p.year - event_year, -3), 5) END AS relative_year
      FROM panel p LEFT JOIN e USING (grid_id))""",
)
def event_study(spark, sf):
    df = T.panel(spark, sf).select(*KEYS, (F.col("canopy_share") * 100).alias("canopy"))
    events = event_years(df, "grid_id", "canopy")
    return event_dummies(df.drop("canopy"), "grid_id", events)
