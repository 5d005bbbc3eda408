"""Correlations, rankings and feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.operators import correlation as C
from terrapanel.operators import neighbours
from terrapanel.operators import ranking as RK
from terrapanel.operators.panel import temporal_split
from terrapanel.operators.selection import select_by_consensus
from terrapanel.plans import tables as T
from terrapanel.plans.registry import query

_X = T.PREDICTORS
_COLS = ["elec_kwh", *_X]
_METHODS = ["pearson", "log_target", "season", "none"]


def _union(template: str, columns=_X, source: str = "panel") -> str:
    return " UNION ALL ".join(f"SELECT {template.format(c=c)} FROM {source}" for c in columns)


@query(
    "corr_with_target",
    f"SELECT feature, correlation, abs(correlation) AS abs_correlation FROM ({_union(chr(39) + '{c}' + chr(39) + ' AS feature, corr({c}, elec_kwh) AS correlation')}) ORDER BY 3 DESC, 1",
    "correlation abs_correlation",
)
def corr_with_target(spark, sf):
    return C.target_correlation(T.panel(spark, sf), _X, "elec_kwh").orderBy(F.desc("abs_correlation"), "feature")


def _pair_sql(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, " + ("CAST(1 AS DOUBLE)" if a == b else f"corr({a}, {b})")
        + f" AS r, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {source}"
        for a in columns for b in columns
    )


@query("corr_matrix", _pair_sql("panel", _COLS), "r")
def corr_matrix(spark, sf):
    return C.correlation_pairs(T.stored_panel(spark, sf), _COLS)


_GAPPY = """, j AS (SELECT b.elec_kwh, s.rhu, CASE WHEN b.nightlight > 0 THEN b.gdp_per_capita END AS gdp_per_capita
  FROM panel b LEFT JOIN orders_panel s
  ON b.grid_id = s.grid_id AND b.year = s.year AND b.month = s.month) """


def _gappy(spark, sf):
    keys = ["grid_id", "year", "month"]
    base = T.panel(spark, sf).select(*keys, "elec_kwh", F.when(F.col("nightlight") > 0, F.col("gdp_per_capita")).alias("gdp_per_capita"))
    return base.join(T.orders_panel(spark, sf).select(*keys, "rhu"), keys, "left")


@query("corr_matrix_pairwise", _GAPPY + _pair_sql("j", ["elec_kwh", "rhu", "gdp_per_capita"]), "r")
def corr_matrix_pairwise(spark, sf):
    """Each pair over the rows where both are present."""
    return C.correlation_pairs(_gappy(spark, sf), ["elec_kwh", "rhu", "gdp_per_capita"])


# Critical values of t by their expansion around the normal quantile, for the levels of the stars.
_CRITICAL = "({z} + ({z} ** 3 + {z}) / (4 * v) + (5 * {z} ** 5 + 16 * {z} ** 3 + 3 * {z}) / (96 * v * v))"
_STARRED = f""", c AS ({_pair_sql("panel", _COLS)}),
t AS (SELECT *, CAST(n - 2 AS DOUBLE) AS v, abs(r) * sqrt((n - 2) / greatest(1 - r * r, 1e-300)) AS t FROM c),
g AS (SELECT x, y, r, n, CASE WHEN x = y THEN '' WHEN t > {_CRITICAL.format(z="3.2905267314919255")} THEN '***'
  WHEN t > {_CRITICAL.format(z="2.5758293035489004")} THEN '**' WHEN t > {_CRITICAL.format(z="1.959963984540054")} THEN '*'
  ELSE '' END AS stars FROM t) """


@query("corr_significance", _STARRED + "SELECT * FROM g", "r")
def corr_significance(spark, sf):
    """Correlations with their stars; the p values behind these have no SQL form."""
    return C.significance_table(T.stored_panel(spark, sf), _COLS).drop("p")


@query(
    "corr_formatted",
    _STARRED + "SELECT x, " + ", ".join(
        f"max(CASE WHEN y <> '{c}' THEN NULL WHEN list_position({_COLS!r}, x) <= {i + 1} THEN printf('%.3f', r) || stars ELSE '' END) AS {c}"
        for i, c in enumerate(_COLS)
    ) + " FROM g GROUP BY x",
)
def corr_formatted(spark, sf):
    return C.formatted_matrix(C.significance_table(T.stored_panel(spark, sf), _COLS), _COLS, keep="upper")


_RANKED = ["elec_kwh", "rhu", "nightlight"]


@query(
    "spearman_matrix",
    ", k AS (SELECT "
    + ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / CAST(2 AS DOUBLE) AS {c}" for c in _RANKED
    )
    + " FROM panel) " + _pair_sql("k", _RANKED),
    "r",
)
def spearman_matrix(spark, sf):
    return C.significance_table(T.stored_panel(spark, sf), _RANKED, "spearman").select("x", "y", "r", "n")


@query(
    "strongest_partner",
    f", c AS ({_pair_sql('panel', _COLS)}) SELECT x AS feature, arg_max(y, abs(r)) AS partner, arg_max(r, abs(r)) AS r "
    "FROM c WHERE x <> y AND x <> 'elec_kwh' GROUP BY 1",
    "r",
)
def strongest_partner(spark, sf):
    return C.strongest_partner(C.correlation_pairs(T.stored_panel(spark, sf), _COLS), _X)


_BINS = 8


@query(
    "mutual_information",
    ", cuts AS (SELECT "
    + ", ".join(
        f"list_distinct(quantile_cont(CAST({c} AS DOUBLE), [{', '.join(str(i / _BINS) for i in range(1, _BINS))}])) AS q_{c}"
        for c in _COLS
    )
    + " FROM panel), coded AS (SELECT len(list_filter(q_elec_kwh, lambda q: q < elec_kwh)) AS yb, "
    + ", ".join(f"len(list_filter(q_{c}, lambda q: q < {c})) AS {c}" for c in _X)
    + " FROM panel, cuts), cells0 AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS xb, yb, count(*) AS n FROM coded GROUP BY 2, 3" for c in _X)
    + """), w AS (SELECT *, sum(n) OVER (PARTITION BY feature, xb) AS nx, sum(n) OVER (PARTITION BY feature, yb) AS ny,
      sum(n) OVER (PARTITION BY feature) AS nn FROM cells0)
    SELECT feature, greatest(sum(n / nn * ln(n * CAST(nn AS DOUBLE) / (nx * ny))), 0.0) AS importance FROM w GROUP BY 1""",
    "importance",
)
def mutual_information(spark, sf):
    return C.mutual_information(T.stored_panel(spark, sf), _X, "elec_kwh", bins=_BINS)


_SCALED = ("gdp_per_capita / 65536", "elec_kwh / 131072")  # powers of two: equal gaps stay equal in both engines


@query(
    "neighbour_information",
    f""", p AS (SELECT row_number() OVER () AS i, {_SCALED[0]} AS x, {_SCALED[1]} AS y FROM panel),
    n AS (SELECT a.i, list_sort(min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3))[3] AS r FROM p a, p b WHERE a.i <> b.i GROUP BY 1),
    q AS (SELECT p.i, p.x, p.y, n.r FROM p JOIN n USING (i)),
    c AS (SELECT q.i, count(*) FILTER (WHERE abs(q.x - b.x) < r OR q.x = b.x) - 1 AS nx, count(*) FILTER (WHERE abs(q.y - b.y) < r OR q.y = b.y) - 1 AS ny
      FROM q, p b GROUP BY 1),
    h AS (SELECT 0 AS m, CAST(0 AS DOUBLE) AS h UNION ALL SELECT m, sum(1.0 / m::DOUBLE) OVER (ORDER BY m) FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM panel))) AS m))
    SELECT 'gdp_per_capita' AS feature, greatest(0.0, (SELECT h FROM h WHERE m = (SELECT count(*) - 1 FROM panel)) + 1.5 - avg(u.h + v.h)) AS importance
    FROM c JOIN h u ON u.m = nx JOIN h v ON v.m = ny""",
    "importance",
)
def neighbour_information(spark, sf):
    """Information of one feature by three nearest neighbours, held against all pairs."""
    scaled = T.stored_panel(spark, sf).select((F.col("gdp_per_capita") / 65536).alias("gdp_per_capita"), (F.col("elec_kwh") / 131072).alias("y"))
    return neighbours.neighbour_information(scaled, ["gdp_per_capita"], "y", standardize=False)


# --- consensus --------------------------------------------------------------------------

_SCORES = (
    ", scores AS ("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS method, '{c}' AS feature, {e.format(c=c)} AS importance FROM panel"
        for m, e in (
            ("pearson", "abs(corr({c}, elec_kwh))"),
            ("log_target", "abs(corr({c}, ln(elec_kwh)))"),
            ("season", "abs(corr({c}, month))"),
            ("none", "0.0 * count({c})"),
        )
        for c in _X
        if not (m == "season" and c == "prec")
    )
    + """), best AS (SELECT method, max(importance) AS b FROM scores GROUP BY 1),
  grid AS (SELECT f.feature, m.method, CASE WHEN b > 0 THEN coalesce(s.importance, 0) / b ELSE 0 END AS v
    FROM (SELECT DISTINCT feature FROM scores) f CROSS JOIN best m LEFT JOIN scores s
    ON s.feature = f.feature AND s.method = m.method),
  consensus AS (SELECT feature, avg(v) AS mean_importance, stddev_pop(v) AS std_importance, min(v) AS min_importance,
    max(v) AS max_importance, CAST(count(*) FILTER (WHERE v > 0) AS INT) AS methods_count FROM grid GROUP BY 1)
"""
)


def scores(spark, sf):
    """Long (method, feature, importance); one method scores nothing and one skips a feature."""
    df = T.panel(spark, sf).withColumn("ln_elec_kwh", F.log("elec_kwh"))
    # one aggregation for all methods
    targets = {"pearson": "elec_kwh", "log_target": "ln_elec_kwh", "season": "month"}
    structs = [
        F.struct(F.lit(m).alias("method"), F.lit(c).alias("feature"), F.abs(F.corr(c, t)).alias("importance"))
        for m, t in targets.items()
        for c in _X
        if not (m == "season" and c == "prec")
    ]
    structs += [
        F.struct(F.lit("none").alias("method"), F.lit(c).alias("feature"), F.lit(0.0).alias("importance")) for c in _X
    ]
    return df.agg(F.array(*structs).alias("r")).select(F.inline("r"))


def _consensus(spark, sf):
    return RK.consensus_ranking(scores(spark, sf), _METHODS, _X)


_GROUPS = "CASE WHEN feature IN ('rhu', 'prec') THEN 'climate_raw' WHEN feature = 'canopy_share' THEN 'canopy' ELSE 'socioeconomic_raw' END"
_STATS = "mean_importance std_importance min_importance max_importance"


@query("consensus_ranking", _SCORES + f'SELECT *, {_GROUPS} AS "group" FROM consensus', _STATS)
def consensus_ranking(spark, sf):
    return _consensus(spark, sf)


@query(
    "wide_scores",
    _SCORES + """SELECT feature, max(CASE WHEN method = 'pearson' THEN importance ELSE 0 END) AS pearson,
    max(CASE WHEN method = 'log_target' THEN importance ELSE 0 END) AS log_target,
    max(CASE WHEN method = 'season' THEN importance ELSE 0 END) AS season, CAST(0 AS DOUBLE) AS none FROM scores GROUP BY 1""",
    "pearson log_target season none",
)
def wide_scores(spark, sf):
    return RK.wide_scores(scores(spark, sf), _METHODS)


@query(
    "cumulative_share",
    _SCORES + """SELECT feature, mean_importance, sum(mean_importance) OVER (ORDER BY mean_importance DESC, feature
    ROWS UNBOUNDED PRECEDING) / sum(mean_importance) OVER () AS cumulative_importance FROM consensus""",
    "mean_importance cumulative_importance",
)
def cumulative_share(spark, sf):
    return RK.cumulative_share(_consensus(spark, sf)).select("feature", "mean_importance", "cumulative_importance")


@query(
    "select_features",
    _SCORES + """, c AS (SELECT feature, mean_importance, sum(mean_importance) OVER (ORDER BY mean_importance DESC, feature
    ROWS UNBOUNDED PRECEDING) / sum(mean_importance) OVER () AS cum, row_number() OVER (ORDER BY mean_importance DESC, feature)
    AS r FROM consensus)
    SELECT feature, CAST(r AS INT) AS rank FROM c WHERE r <= (SELECT least(greatest(count(*) FILTER (WHERE cum <= 0.8), 2), 4) FROM c)""",
)
def select_features(spark, sf):
    return RK.select_features(_consensus(spark, sf), 0.8, 2, 4).select("feature", "rank")


@query(
    "top_features",
    _SCORES + "SELECT feature, mean_importance FROM consensus ORDER BY mean_importance DESC, feature LIMIT 3",
    "mean_importance",
)
def top_features(spark, sf):
    return RK.top_k(_consensus(spark, sf), "mean_importance", 3).select("feature", "mean_importance")


@query("mean_importance", _SCORES + "SELECT feature, avg(importance) AS importance FROM scores GROUP BY 1", "importance")
def mean_importance(spark, sf):
    return RK.mean_importance(scores(spark, sf))


@query(
    "selected_scores",
    _SCORES + """SELECT method, feature, importance FROM scores WHERE feature IN (
    SELECT feature FROM consensus ORDER BY mean_importance DESC, feature LIMIT 3)""",
    "importance",
)
def selected_scores(spark, sf):
    table = scores(spark, sf)
    return RK.keep_selected(table, RK.top_k(RK.consensus_ranking(table, _METHODS), "mean_importance", 3))


@query("consensus_of_models")
def consensus_of_models(spark, sf):
    """Consensus of a forest, boosted trees, lasso and nearest-neighbour information on the training years, with the selection."""
    keys = ["grid_id", "year", "month"]
    train = temporal_split(T.stored_panel(spark, sf).withColumn("ln_elec_kwh", F.log("elec_kwh")), T.YEARS).filter("split = 'train'")
    small = {"numTrees": 20, "maxDepth": 5}, {"maxIter": 10, "maxDepth": 4}
    table, selected = select_by_consensus(
        train, _X, "ln_elec_kwh", keys, 0.95, 3, 5, forest=small[0], boosted=small[1]
    )
    chosen = selected.select("feature", "rank")
    return table.join(chosen, "feature", "left").withColumn("selected", F.col("rank").isNotNull())
