"""Linear, fixed-effects and tree models, folds, scores and attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.functions.scalars import complete_rows
from terrapanel.operators import attribution as A
from terrapanel.operators import fixed_effects as FE
from terrapanel.operators import folds as FO
from terrapanel.operators import linear as L
from terrapanel.operators import trees as TR
from terrapanel.operators.conley import spatial_meat
from terrapanel.operators.panel import temporal_split
from terrapanel.operators.ranking import mean_importance, with_method
from terrapanel.plans import tables as T
from terrapanel.plans.registry import query

KEYS = ["grid_id", "year", "month"]
_Y = "ln(elec_kwh)"


def _data(spark, sf):
    return T.stored_panel(spark, sf).withColumn("ln_elec_kwh", F.log("elec_kwh"))


# --- scaling and folds ------------------------------------------------------------------


@query(
    "standardize",
    """SELECT grid_id, year, month, (rhu - avg(rhu) OVER ()) / stddev_pop(rhu) OVER () AS rhu,
    (prec - avg(prec) OVER ()) / stddev_pop(prec) OVER () AS prec FROM panel""",
    "rhu prec",
)
def standardize(spark, sf):
    df = T.stored_panel(spark, sf).select(*KEYS, "rhu", "prec")
    return L.Standardizer(["rhu", "prec"]).fit(df).transform(df)


@query("contiguous_folds", "SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INT) AS fold FROM orders")
def contiguous_folds(spark, sf):
    return FO.contiguous_folds(T.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5)


@query(
    "entity_folds",
    "SELECT city_name, CAST(1 AS BIGINT) AS folds, count(*) AS rows FROM panel JOIN cities USING (grid_id) GROUP BY 1",
)
def entity_folds(spark, sf):
    """Every city lies in exactly one fold."""
    joined = T.panel(spark, sf).join(T.cities(spark, sf).select("grid_id", "city_name"), "grid_id")
    tagged = FO.entity_folds(joined, "city_name", 5)
    return tagged.groupBy("city_name").agg(F.count_distinct("fold").alias("folds"), F.count(F.lit(1)).alias("rows"))


@query("hashed_folds", "SELECT CAST(5 AS BIGINT) AS folds, count(*) AS rows, true AS balanced FROM panel")
def hashed_folds(spark, sf):
    """Every row in one of five folds of about equal size."""
    tagged = FO.hashed_folds(T.panel(spark, sf).select(*KEYS), KEYS, 5)
    sizes = tagged.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count_if(F.col("fold").between(0, 4)).alias("folds"), F.sum("n").alias("rows"),
        (F.min("n") * 2 > F.avg("n")).alias("balanced"),
    )


# --- ridge and lasso ---------------------------------------------------------------------

_MOMENTS = f""", m AS (SELECT count(*) AS n, avg(rhu) AS m1, avg(prec) AS m2, avg({_Y}) AS my, var_pop(rhu) * count(*) AS s11,
  var_pop(prec) * count(*) AS s22, covar_pop(rhu, prec) * count(*) AS s12, covar_pop(rhu, {_Y}) * count(*) AS s1y,
  covar_pop(prec, {_Y}) * count(*) AS s2y FROM panel),
 r AS (SELECT *, ((s22 + 10) * s1y - s12 * s2y) / ((s11 + 10) * (s22 + 10) - s12 * s12) AS b1,
  ((s11 + 10) * s2y - s12 * s1y) / ((s11 + 10) * (s22 + 10) - s12 * s12) AS b2 FROM m)
"""


def _ridge(df):
    return L.fit_linear(df, ["rhu", "prec"], "ln_elec_kwh", "ridge", 10.0)


def _terms(spark, model):
    rows = list(zip(model.features, model.coefficients)) + [("(intercept)", model.intercept)]
    return spark.createDataFrame([(n, float(v)) for n, v in rows], "term string, estimate double")


@query(
    "ridge",
    _MOMENTS + """SELECT 'rhu' AS term, b1 AS estimate FROM r UNION ALL SELECT 'prec', b2 FROM r
    UNION ALL SELECT '(intercept)', my - b1 * m1 - b2 * m2 FROM r""",
    "estimate",
)
def ridge(spark, sf):
    return _terms(spark, _ridge(_data(spark, sf)))


@query(
    "lasso",
    f""", m AS (SELECT count(*) AS n, avg(population) AS mx, avg({_Y}) AS my, var_pop(population) * count(*) AS xx,
      covar_pop(population, {_Y}) * count(*) AS xy FROM panel),
    b AS (SELECT *, sign(xy) * greatest(abs(xy) - n * 0.01, 0) / xx AS b FROM m)
    SELECT 'population' AS term, b AS estimate FROM b UNION ALL SELECT '(intercept)', my - b * mx FROM b""",
    "estimate",
)
def lasso(spark, sf):
    return _terms(spark, L.fit_linear(_data(spark, sf), ["population"], "ln_elec_kwh", "lasso", 0.01))


_TERMS = "unnest([" + ", ".join(f"'{p}'" for p in T.PREDICTORS) + "])"


@query("lasso_all", f"SELECT {_TERMS} AS term, true AS optimal")
def lasso_all(spark, sf):
    """Whether each coefficient meets the conditions of the optimum, taken over all rows."""
    df = complete_rows(_data(spark, sf))
    scaled = L.Standardizer(T.PREDICTORS).fit(df).transform(df)
    alpha = 0.01
    model = L.fit_linear(scaled, T.PREDICTORS, "ln_elec_kwh", "lasso", alpha)
    rest = F.col("ln_elec_kwh") - model.prediction()
    slopes = scaled.agg(*[F.covar_pop(F.col(c), rest).alias(c) for c in T.PREDICTORS], F.avg(rest).alias("_mean"))
    checks = []
    for c, b in zip(model.features, model.coefficients):
        g = F.col(c)
        held = F.abs(g - F.lit(alpha if b > 0 else -alpha)) < 1e-6 if b else F.abs(g) <= alpha + 1e-6
        checks.append(F.struct(F.lit(c).alias("term"), (held & (F.abs("_mean") < 1e-6)).alias("optimal")))
    return slopes.select(F.inline(F.array(*checks)))


_ALPHAS = ", ".join(str(a) for a in L.RIDGE_ALPHAS)


@query(
    "ridge_grid_search",
    f""", f AS (SELECT grid_id % 5 AS k, count(*) AS n, sum(rhu) AS sx, sum({_Y}) AS sy, sum(rhu * rhu) AS sxx,
      sum(rhu * {_Y}) AS sxy, sum({_Y} * {_Y}) AS syy FROM panel GROUP BY 1),
    t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM f),
    fit AS (SELECT f.*, a AS alpha, ((t.sxy - f.sxy) - (t.sx - f.sx) * (t.sy - f.sy) / (t.n - f.n)) /
      ((t.sxx - f.sxx) - (t.sx - f.sx) ** 2 / (t.n - f.n) + a) AS b, (t.sx - f.sx) / (t.n - f.n) AS mx,
      (t.sy - f.sy) / (t.n - f.n) AS my FROM f, t, (SELECT unnest([{_ALPHAS}]::DOUBLE[]) AS a)),
    e AS (SELECT alpha, (syy - 2 * b * sxy + b * b * sxx - 2 * (my - b * mx) * (sy - b * sx) + n * (my - b * mx) ** 2) / n AS mse FROM fit)
    SELECT alpha, avg(mse) AS cv_mse FROM e GROUP BY 1""",
    "cv_mse:8",
)
def ridge_grid_search(spark, sf):
    df = _data(spark, sf).withColumn("fold", (F.col("grid_id") % 5).cast("int"))
    found = L.grid_search(df, ["rhu"], "ln_elec_kwh", "fold", "ridge", L.RIDGE_ALPHAS)
    return spark.createDataFrame([(float(a), v) for a, v in found.cv_mse.items()], "alpha double, cv_mse double")


_PENALTIES = " UNION ALL ".join(
    f"SELECT '{kind}' AS model, CAST({a} AS DOUBLE) AS alpha, true AS same, true AS best_is_least"
    for kind, alphas in (("ridge", L.RIDGE_ALPHAS), ("lasso", L.LASSO_ALPHAS)) for a in alphas
)


def penalty_grid(spark, sf):
    """Errors of ridge and lasso over their full penalty grids on all predictors, from one pass; ``penalty_search`` checks them."""
    df = complete_rows(FO.entity_folds(_data(spark, sf), "grid_id", 5))
    scaled = L.Standardizer(T.PREDICTORS).fit(df).transform(df)
    moments = L.fold_moments(scaled, T.PREDICTORS, "ln_elec_kwh", "fold", 5)
    rows = []
    for kind, alphas in (("ridge", L.RIDGE_ALPHAS), ("lasso", L.LASSO_ALPHAS)):
        found = L.grid_search(scaled, T.PREDICTORS, "ln_elec_kwh", "fold", kind, alphas, moments=moments)
        rows += [(kind, float(a), float(v)) for a, v in found.cv_mse.items()]
    return spark.createDataFrame(rows, "model string, alpha double, cv_mse double")


@query("penalty_search", _PENALTIES)
def penalty_search(spark, sf):
    """Ridge and lasso over their full penalty grids on all predictors, from one pass.

    Each setting's error, which comes from cross products, is held against the errors of its
    models' predictions on the left-out rows.
    """
    df = complete_rows(FO.entity_folds(_data(spark, sf), "grid_id", 5))
    scaled = L.Standardizer(T.PREDICTORS).fit(df).transform(df)
    moments = L.fold_moments(scaled, T.PREDICTORS, "ln_elec_kwh", "fold", 5)
    checks = []
    for kind, alphas in (("ridge", L.RIDGE_ALPHAS), ("lasso", L.LASSO_ALPHAS)):
        found = L.grid_search(scaled, T.PREDICTORS, "ln_elec_kwh", "fold", kind, alphas, moments=moments)
        least = found.cv_mse[found.best_alpha] <= min(found.cv_mse.values())
        for a, v in found.cv_mse.items():
            folds = []
            for k in range(5):
                gap = F.col("ln_elec_kwh") - L.solve(moments, kind, a, without=k).prediction()
                folds.append(F.avg(F.when(F.col("fold") == k, gap * gap)))
            mean = sum(folds[1:], folds[0]) / 5
            checks.append(F.struct(
                F.lit(kind).alias("model"), F.lit(float(a)).alias("alpha"), (F.abs(mean - v) < 1e-8).alias("same"),
                F.lit(least).alias("best_is_least"),
            ))
    return scaled.agg(F.array(*checks).alias("r")).select(F.inline("r"))


@query(
    "regression_metrics",
    f""", s AS (SELECT *, CASE WHEN year <= 1999 THEN 'train' WHEN year = 2000 THEN 'validation' ELSE 'test' END AS split,
      {_Y} AS y FROM panel), b AS (SELECT regr_slope(y, population) AS b, regr_intercept(y, population) AS a FROM s WHERE split = 'train'),
    p AS (SELECT split, y, y - a - b * population AS e FROM s, b)
    SELECT split, count(*) AS n, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae
    FROM p GROUP BY 1""",
    "r2 rmse mae",
)
def regression_metrics(spark, sf):
    df = temporal_split(_data(spark, sf), T.YEARS)
    model = L.fit_linear(df.filter(F.col("split") == "train"), ["population"], "ln_elec_kwh", "ridge", 0.0)
    return L.regression_metrics(model.transform(df), "ln_elec_kwh", by=["split"])


# --- linear attributions -----------------------------------------------------------------

_SHAP = _MOMENTS + """, a AS (SELECT grid_id, year, month, b1 * (rhu - m1) AS rhu, b2 * (prec - m2) AS prec, my AS base_value FROM panel, r) """


def _linear_shap(spark, sf):
    df = _data(spark, sf)
    return A.linear_attributions(_ridge(df), df, KEYS)


@query("linear_attributions", _SHAP + "SELECT * FROM a", "rhu prec base_value")
def linear_attributions(spark, sf):
    return _linear_shap(spark, sf)


@query(
    "attribution_importance",
    _SHAP + """, t AS (SELECT 'rhu' AS feature, avg(abs(rhu)) AS shap_importance, avg(rhu) AS mean_effect FROM a UNION ALL
    SELECT 'prec', avg(abs(prec)), avg(prec) FROM a)
    SELECT *, CAST(row_number() OVER (ORDER BY shap_importance DESC) AS INT) AS rank FROM t""",
    "shap_importance mean_effect",
)
def attribution_importance(spark, sf):
    return A.mean_absolute(_linear_shap(spark, sf), ["rhu", "prec"])


@query(
    "attribution_categories",
    _SHAP + """SELECT 'Climate' AS category, avg(abs(rhu) + abs(prec)) / 2 AS importance, avg(rhu + prec) / 2 AS effect,
    CAST(2 AS INT) AS n_features FROM a""",
    "importance effect",
)
def attribution_categories(spark, sf):
    return A.category_rollup(_linear_shap(spark, sf), ["rhu", "prec"])


@query(
    "savings_summary",
    _SHAP + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, -avg({c}) FILTER (WHERE {c} < 0) AS avg_log_reduction,
        (exp(-avg({c}) FILTER (WHERE {c} < 0)) - 1) * 100 AS approx_pct_savings,
        count(*) FILTER (WHERE {c} < 0) AS samples_with_savings, count(*) AS total_samples FROM a""" for c in ("rhu", "prec")
    ),
    "avg_log_reduction approx_pct_savings",
)
def savings_summary(spark, sf):
    return A.savings_summary(_linear_shap(spark, sf), ["rhu", "prec"])


@query(
    "interesting_cases",
    """, c AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS hi,
      row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS lo, count(*) OVER () AS n FROM orders),
    k AS (SELECT o_orderkey, 'high_consumption' AS "case" FROM c WHERE hi <= 5 UNION ALL SELECT o_orderkey, 'low_consumption'
      FROM c WHERE lo <= 5 UNION ALL SELECT o_orderkey, 'median_consumption' FROM c WHERE lo - 1 BETWEEN n // 2 - 2 AND n // 2 + 2)
    SELECT * FROM k""",
)
def interesting_cases(spark, sf):
    orders = T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return A.interesting_cases(orders, "o_totalprice", "o_orderkey").select("o_orderkey", "case")


# --- fixed effects --------------------------------------------------------------------------

_FE = f""", d AS (SELECT grid_id, {_Y} AS y0, {_Y} - avg({_Y}) OVER (PARTITION BY grid_id) AS y,
   rhu - avg(rhu) OVER (PARTITION BY grid_id) AS x FROM panel),
 b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, count(*) AS n, sum(y * y) AS yy,
   count(DISTINCT grid_id) AS g FROM d),
 s AS (SELECT grid_id, sum(x * (y - b * x)) AS s FROM d, b GROUP BY 1)
"""


def _one(spark, sf, **kw):
    df = _data(spark, sf)
    if kw:
        df = df.join(T.cities(spark, sf).select("grid_id", "city_id", "lon", "lat"), "grid_id")
    return FE.fixed_effects_ols(df, "ln_elec_kwh", ["rhu"], ["grid_id"], **kw)


def _estimates(spark, fit):
    return FE.coefficient_table(spark, {"m": fit}).select("term", "estimate", "std_error")


@query(
    "fe_ols_one_regressor",
    _FE + "SELECT 'rhu' AS term, b AS estimate, sqrt((yy - b * b * xx) / (n - g - 1) / xx) AS std_error FROM b",
    "estimate std_error",
)
def fe_ols_one_regressor(spark, sf):
    return _estimates(spark, _one(spark, sf))


@query(
    "fe_ols_two_regressors",
    f""", d AS (SELECT {_Y} - avg({_Y}) OVER w AS y, rhu - avg(rhu) OVER w AS a, gdp_per_capita - avg(gdp_per_capita) OVER w AS b,
      grid_id FROM panel WINDOW w AS (PARTITION BY grid_id)),
    s AS (SELECT count(*) AS n, count(DISTINCT grid_id) AS g, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb,
      sum(a * y) AS ay, sum(b * y) AS by_, sum(y * y) AS yy FROM d),
    f AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS b1,
      (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS b2 FROM s),
    v AS (SELECT *, (yy - b1 * ay - b2 * by_) / (n - g - 2) AS s2 FROM f)
    SELECT 'rhu' AS term, b1 AS estimate, sqrt(s2 * bb / det) AS std_error FROM v UNION ALL
    SELECT 'gdp_per_capita', b2, sqrt(s2 * aa / det) FROM v""",
    "estimate:12 std_error:12",
)
def fe_ols_two_regressors(spark, sf):
    fit = FE.fixed_effects_ols(_data(spark, sf), "ln_elec_kwh", ["rhu", "gdp_per_capita"], ["grid_id"])
    return _estimates(spark, fit)


@query(
    "fe_ols_statistics",
    _FE + """SELECT 'grid_id' AS effects, n, g + 1 AS parameters,
    1 - (yy - b * b * xx) / (SELECT var_pop(y0) * count(*) FROM d) AS r2, b * b * xx / yy AS within_r2 FROM b""",
    "r2 within_r2",
)
def fe_ols_statistics(spark, sf):
    return FE.statistics_table(spark, {"m": _one(spark, sf)}).select("effects", "n", "parameters", "r2", "within_r2")


@query(
    "fe_ols_clustered",
    _FE + """, c AS (SELECT city_id, sum(s) AS s FROM s JOIN cities USING (grid_id) GROUP BY 1)
    SELECT 'rhu' AS term, any_value(b) AS estimate, sqrt(sum(s * s) * any_value((n - 1) / CAST(n - g - 1 AS DOUBLE))
      * count(*) / (count(*) - 1)) / any_value(xx) AS std_error FROM c, b""",
    "estimate std_error",
)
def fe_ols_clustered(spark, sf):
    return _estimates(spark, _one(spark, sf, vcov="cluster", cluster="city_id"))


_NEAR = """sqrt((a.lat - c.lat) ** 2 + (cos(radians((a.lat + c.lat) / 2)) * (a.lon - c.lon)) ** 2) * 111.0 <= 100"""


@query(
    "fe_ols_conley",
    _FE + f""", q AS (SELECT s, lon, lat FROM s JOIN cities USING (grid_id)),
    meat AS (SELECT sum(a.s * c.s) AS v FROM q a JOIN q c ON {_NEAR})
    SELECT 'rhu' AS term, b AS estimate, sqrt(v * (n - 1) / CAST(n - g - 1 AS DOUBLE)) / xx AS std_error FROM meat, b""",
    "estimate std_error",
)
def fe_ols_conley(spark, sf):
    return _estimates(spark, _one(spark, sf, vcov="conley"))


@query(
    "spatial_pair_sum",
    f""", w AS (SELECT lon, lat, sum(elec_kwh) / 1e6 AS s FROM panel JOIN cities USING (grid_id) GROUP BY 1, 2)
    SELECT sum(a.s * c.s) AS total FROM w a JOIN w c ON {_NEAR.replace('<= 100', '<= 400')}""",
    "total:4",
)
def spatial_pair_sum(spark, sf):
    """Sum of products over all pairs of places within 400 km."""
    w = T.panel(spark, sf).join(T.cities(spark, sf), "grid_id").groupBy("lon", "lat").agg(
        (F.sum("elec_kwh") / 1e6).alias("s")
    )
    total = spatial_meat(w, ["s"], 400.0)[0, 0]
    return spark.createDataFrame([(float(total),)], "total double")


@query(
    "coefficient_comparison",
    f""", t AS (SELECT *, CASE WHEN canopy_share <= 0.1 THEN 'Low' ELSE 'High' END AS lv FROM panel),
    d AS (SELECT lv, {_Y} - avg({_Y}) OVER (PARTITION BY lv, grid_id) AS y, rhu - avg(rhu) OVER (PARTITION BY lv, grid_id) AS x FROM t),
    b AS (SELECT lv, sum(x * y) / sum(x * x) AS b FROM d GROUP BY 1)
    SELECT 'rhu' AS term, l.b AS first, h.b AS second, l.b - h.b AS difference, (l.b - h.b) / l.b * 100 AS reduction_pct
    FROM b l, b h WHERE l.lv = 'Low' AND h.lv = 'High'""",
    "first second difference reduction_pct:6",
)
def coefficient_comparison(spark, sf):
    df = _data(spark, sf)
    low = df.filter(F.col("canopy_share") <= 0.1)
    high = df.filter(F.col("canopy_share") > 0.1)
    fits = {
        "low": FE.fixed_effects_ols(low, "ln_elec_kwh", ["rhu"], ["grid_id"]),
        "high": FE.fixed_effects_ols(high, "ln_elec_kwh", ["rhu"], ["grid_id"]),
    }
    return FE.compare_coefficients(FE.coefficient_table(spark, fits), "low", "high")


# --- trees ------------------------------------------------------------------------------------

_FOREST = {"numTrees": 20, "maxDepth": 5}
_BOOSTED = {"maxIter": 10, "maxDepth": 4, "stepSize": 0.1}


def _train(spark, sf):
    return temporal_split(_data(spark, sf), T.YEARS).filter(F.col("split") == "train")


_RECOMPUTED = f"SELECT {_TERMS} AS feature, true AS as_recomputed, CAST(1 AS DOUBLE) AS total"


def _against_gains(given, recomputed):
    """Whether each importance is that of the gains in the node tables, and what the importances add up to."""
    total = given.agg(F.sum("importance").alias("total"))
    both = given.join(recomputed.withColumnRenamed("importance", "own"), "feature", "left")
    same = F.coalesce(F.abs(F.col("importance") - F.col("own")) < 1e-9, F.lit(False)) & (F.col("importance") > 0)
    return both.crossJoin(total).select("feature", same.alias("as_recomputed"), "total")  # one row


@query("forest_importance", _RECOMPUTED, "total")
def forest_importance(spark, sf):
    df = _train(spark, sf)
    model = TR.fit_ensemble(df, T.PREDICTORS, "ln_elec_kwh", "forest", **_FOREST)
    return _against_gains(TR.impurity_importance(model, df, T.PREDICTORS), TR.gain_importance(model, df, T.PREDICTORS))


def _both_ensembles(spark, sf, importance):
    df = _train(spark, sf)
    parts = []
    for kind, params in (("forest", _FOREST), ("boosted", _BOOSTED)):
        model = TR.fit_ensemble(df, T.PREDICTORS, "ln_elec_kwh", kind, **params)
        parts.append([with_method(f(model, df, T.PREDICTORS), kind) for f in importance])
    return [a.unionByName(b) for a, b in zip(*parts)]


@query("average_importance", _RECOMPUTED, "total")
def average_importance(spark, sf):
    """Mean importance over a forest and boosted trees."""
    given, own = _both_ensembles(spark, sf, (TR.impurity_importance, TR.gain_importance))
    return _against_gains(mean_importance(given), mean_importance(own))


@query("importance_values")
def importance_values(spark, sf):
    """The importances themselves, by method."""
    return _both_ensembles(spark, sf, (TR.impurity_importance,))[0]


@query("model_comparison")
def model_comparison(spark, sf):
    df = complete_rows(temporal_split(_data(spark, sf), T.YEARS).select(*KEYS, *T.PREDICTORS, "ln_elec_kwh", "split"))
    train = df.filter(F.col("split") == "train")
    folds = FO.entity_folds(train, "grid_id", 5)
    scored, cv = {}, {}
    scale = L.Standardizer(T.PREDICTORS).fit(train)
    scaled = scale.transform(df)
    moments = L.fold_moments(scale.transform(folds), T.PREDICTORS, "ln_elec_kwh", "fold", 5)
    for kind, alphas in (("ridge", L.RIDGE_ALPHAS), ("lasso", L.LASSO_ALPHAS)):
        found = L.grid_search(folds, T.PREDICTORS, "ln_elec_kwh", "fold", kind, alphas, moments=moments)
        scored[kind], cv[kind] = found.model.transform(scaled), found.cv_rmse
    for kind, params in (("forest", _FOREST), ("boosted", _BOOSTED)):
        model = TR.fit_ensemble(train, T.PREDICTORS, "ln_elec_kwh", kind, **params)
        scored[kind] = model.transform(df)
    return L.model_comparison(scored, "ln_elec_kwh", cv)


# Smaller than the study's grids, whose values are FOREST_GRID and BOOSTED_GRID of the operator.
_SEARCHED = {
    "forest": {"numTrees": [5, 10, 20], "maxDepth": [3, 5], "minInstancesPerNode": [1, 4]},
    "boosted": {"maxIter": [5, 10, 15], "maxDepth": [3, 5], "stepSize": [0.1, 0.2]},
}


def _searched(kind):
    def plan(spark, sf):
        df = FO.entity_folds(_train(spark, sf), "grid_id", 5)
        _, results = TR.search_by_prefixes(df, T.PREDICTORS, "ln_elec_kwh", kind, _SEARCHED[kind], "fold", 5)
        names = list(_SEARCHED[kind])
        rows = [(*(float(s[n]) for n in names), v) for s, v in results]
        return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "cv_rmse"]))

    return plan


for _kind in _SEARCHED:
    query(f"{_kind}_grid_search")(_searched(_kind))


@query("tree_attributions", "SELECT count(*) AS rows, 0 AS with_gap, 0 AS other_prediction FROM panel WHERE year <= 1999")
def tree_attributions(spark, sf):
    """Rows whose attributions by boosted trees do not add up to the model's prediction, which are none."""
    df = _train(spark, sf).select(*KEYS, *T.PREDICTORS, "ln_elec_kwh")
    model = TR.fit_ensemble(df, T.PREDICTORS, "ln_elec_kwh", "boosted", **_BOOSTED)
    scored = model.transform(df).select(*KEYS, *T.PREDICTORS, "prediction")
    phi = TR.tree_attributions(model, scored, T.PREDICTORS, [*KEYS, "prediction"])
    gap = A.local_accuracy(phi, T.PREDICTORS, F.col("prediction"))
    other = F.abs(F.col("prediction") - F.col("tree_prediction")) > 1e-6
    return phi.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if((F.abs(gap) > 1e-6) | gap.isNull()).cast("int").alias("with_gap"),
        F.count_if(other | other.isNull()).cast("int").alias("other_prediction"),
    )


@query("tree_local_explanations")
def tree_local_explanations(spark, sf):
    df = _train(spark, sf).select(*KEYS, *T.PREDICTORS, "ln_elec_kwh").withColumn(
        "row_id", F.col("grid_id") * 10000 + (F.col("year") - 1990) * 100 + F.col("month")
    )
    model = TR.fit_ensemble(df, T.PREDICTORS, "ln_elec_kwh", "forest", **_FOREST)
    cases = A.interesting_cases(df, "ln_elec_kwh", "row_id")
    phi = TR.tree_attributions(model, cases, T.PREDICTORS, ["case", "row_id"])
    return A.local_explanations(phi, T.PREDICTORS, ["case", "row_id"], top=3)
