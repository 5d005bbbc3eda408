import itertools
import math
import random
import subprocess
import sys
import threading

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.ml.regression import LinearRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from terrapanel.operators import attribution as A
from terrapanel.operators import correlation as C
from terrapanel.operators import fixed_effects as FE
from terrapanel.operators import linear as L
from terrapanel.operators import selection as SE
from terrapanel.operators import trees as TR
from terrapanel.operators.moments import pairwise_correlation
from terrapanel.sources import sinks


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    n = 400
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + [0, 10, 1000.0]
    y = 2 + x @ [1.5, -0.3, 4.0] + rng.normal(size=n)
    return x, y


@pytest.fixture(scope="module")
def frame(spark, table):
    x, y = table
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(3).cache()


def test_ridge_closed_form(frame, table):
    x, y = table
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 3.0 * np.eye(3), xc.T @ yc)
    m = L.fit_linear(frame, ["a", "b", "c"], "y", "ridge", 3.0)
    assert m.coefficients == pytest.approx(want, rel=1e-8)
    assert m.intercept == pytest.approx(y.mean() - want @ x.mean(0), rel=1e-8)


def test_lasso_agrees_with_spark(frame):
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(frame)
    ml = LinearRegression(featuresCol="f", labelCol="y", elasticNetParam=1.0, regParam=0.2, standardization=False, tol=1e-12, maxIter=1000).fit(df)
    m = L.fit_linear(frame, ["a", "b", "c"], "y", "lasso", 0.2)
    assert m.coefficients == pytest.approx(list(ml.coefficients), abs=1e-5)


def test_grid_search_matches_refitting(frame, table):
    x, y = table
    df = frame.withColumn("fold", (F.col("id") % 4).cast("int"))
    got = L.grid_search(df, ["a", "b", "c"], "y", "fold", "ridge", [0.1, 100.0], k=4)
    fold = np.arange(len(y)) % 4
    for alpha, mse in got.cv_mse.items():
        errors = []
        for f in range(4):
            xt, yt = x[fold != f], y[fold != f]
            xc = xt - xt.mean(0)
            b = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ (yt - yt.mean()))
            e = y[fold == f] - yt.mean() - (x[fold == f] - xt.mean(0)) @ b
            errors.append((e**2).mean())
        assert mse == pytest.approx(np.mean(errors), rel=1e-8)


def test_pairwise_correlation_skips_missing_pairs(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, None, 1.0), (3.0, 5.0, 1.0), (None, 1.0, 1.0), (5.0, 4.0, 1.0)]
    r, n = pairwise_correlation(spark.createDataFrame(rows, "a double, b double, k double"), ["a", "b", "k"])
    assert n[0, 1] == 3 and r[0, 1] == pytest.approx(np.corrcoef([1, 3, 5], [2, 5, 4])[0, 1])
    assert math.isnan(r[0, 2]) and math.isnan(r[2, 2])


def test_spearman_with_ties(spark):
    rows = [(1.0, 1.0), (2.0, 1.0), (2.0, 3.0), (4.0, 2.0)]
    t = C.significance_table(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], "spearman")
    got = t.filter("x = 'a' and y = 'b'").first().r
    assert got == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [1.5, 1.5, 4, 3])[0, 1])


# --- fixed effects ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def panel():
    rng = random.Random(9)
    rows = []
    for g in range(12):
        for year in range(2012, 2016):
            for month in range(1, 7):
                if rng.random() < 0.15:
                    continue  # unbalanced
                x1, x2 = rng.gauss(g, 1), rng.gauss(0, 2)
                y = 0.7 * x1 - 0.4 * x2 + g + 0.3 * year % 7 + 0.1 * month + rng.gauss(0, 0.5)
                rows.append((g, year, month, x1, x2, 2 * x1 - x2, float(g), y, 100 + g * 0.4, 30.0 + (g % 3) * 0.4, g // 3))
    return rows


COLUMNS = "g int, year int, month int, x1 double, x2 double, x3 double, x4 double, y double, lon double, lat double, city int"


@pytest.fixture(scope="module")
def panel_frame(spark, panel):
    df = spark.createDataFrame(panel, COLUMNS).withColumn("ym", F.col("year") * 100 + F.col("month"))
    return df.repartition(3).cache()


def dense(panel, effects):
    a = np.array(panel, dtype=float)
    keys = {"g": a[:, 0], "year": a[:, 1], "month": a[:, 2], "ym": a[:, 1] * 100 + a[:, 2]}
    d = np.column_stack([(keys[e] == v).astype(float) for e in effects for v in np.unique(keys[e])])
    x = a[:, 3:5]

    def residual(m):
        return m - d @ np.linalg.lstsq(d, m, rcond=None)[0]

    xr, yr = residual(x), residual(a[:, 7])
    b = np.linalg.lstsq(xr, yr, rcond=None)[0]
    return a, xr, yr, b, yr - xr @ b, np.linalg.matrix_rank(d)


def test_three_way_absorption(panel, panel_frame):
    a, xr, yr, b, e, rank = dense(panel, ["g", "year", "month"])
    fit = FE.fixed_effects_ols(panel_frame, "y", ["x1", "x2", "x3", "x4"], ["g", "year", "month"])
    assert fit.terms == ["x1", "x2"] and fit.dropped == ["x3", "x4"]
    assert fit.estimates == pytest.approx(b, rel=1e-9)
    free = len(a) - rank - 2
    v = np.linalg.inv(xr.T @ xr) * (e @ e) / free
    assert fit.errors == pytest.approx(np.sqrt(np.diag(v)), rel=1e-9)
    assert fit.n == len(a) and fit.parameters == rank + 2
    y = a[:, 7]
    assert fit.r2 == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum())
    assert fit.within_r2 == pytest.approx(1 - e @ e / (yr @ yr))


def test_alternating_sweeps(panel, panel_frame):
    fit = FE.fixed_effects_ols(panel_frame, "y", ["x1", "x2"], ["g", "ym"], dummy_levels=1)
    assert fit.estimates == pytest.approx(dense(panel, ["g", "ym"])[3], rel=1e-7)


@pytest.mark.parametrize("vcov", ["hetero", "cluster", "conley"])
def test_robust_errors(panel, panel_frame, vcov):
    a, xr, yr, b, e, rank = dense(panel, ["g", "year"])
    s = xr * e[:, None]
    n, free = len(a), len(a) - rank - 2
    bread = np.linalg.inv(xr.T @ xr)
    if vcov == "hetero":
        meat, adjust = s.T @ s, n / free
    elif vcov == "cluster":
        sums = np.array([s[a[:, 10] == c].sum(0) for c in np.unique(a[:, 10])])
        meat, adjust = sums.T @ sums, (n - 1) / free * len(sums) / (len(sums) - 1)
    else:
        lon, lat = a[:, 8], a[:, 9]
        d = 111.0 * np.hypot(lat[:, None] - lat, np.cos(np.radians((lat[:, None] + lat) / 2)) * (lon[:, None] - lon))
        meat, adjust = s.T @ (d <= 100) @ s, (n - 1) / free
    want = np.sqrt(np.diag(bread @ meat @ bread) * adjust)
    fit = FE.fixed_effects_ols(panel_frame, "y", ["x1", "x2"], ["g", "year"], vcov=vcov, cluster="city")
    assert fit.errors == pytest.approx(want, rel=1e-8)


def test_coefficient_comparison(spark, panel_frame):
    df, names = FE.interaction(panel_frame, [("x1", "x2")])
    fits = {"a": FE.fixed_effects_ols(df, "y", ["x1", *names], ["g"]), "b": FE.fixed_effects_ols(df, "y", ["x1"], ["g"])}
    t = FE.coefficient_table(spark, fits)
    row = FE.compare_coefficients(t, "a", "b").first()
    assert row.term == "x1" and row.difference == pytest.approx(row["first"] - row["second"])
    assert t.filter("term = 'x1:x2'").count() == 1
    assert FE.statistics_table(spark, fits).count() == 2


# --- attributions -------------------------------------------------------------------------


def tree_value(leaves, x, known):
    """Expected prediction when only the features in ``known`` are looked at."""
    total = 0.0
    for leaf in leaves:
        p = 1.0
        for j, lo, hi, r in zip(leaf.features, leaf.low, leaf.high, leaf.ratio):
            p *= float(lo < x[j] <= hi) if j in known else r
        total += leaf.value * p
    return total


@pytest.mark.parametrize("kind,params", [("forest", {"numTrees": 3, "maxDepth": 3}), ("boosted", {"maxIter": 3, "maxDepth": 2})])
def test_tree_attributions(frame, kind, params, tmp_path):
    names = ["a", "b", "c"]
    model = TR.fit_ensemble(frame, names, "y", kind, **params)
    sinks.save_model(model, str(tmp_path / "m"))
    model = sinks.load_model(str(tmp_path / "m"))
    phi = TR.tree_attributions(model, frame, names, ["id"])
    gap = phi.join(model.transform(frame).select("id", "prediction"), "id").select(
        F.max(F.abs(A.local_accuracy(phi, names, F.col("prediction"))))
    )
    assert gap.first()[0] < 1e-9

    leaves = TR.model_leaves(model, frame)
    row = frame.filter("id = 17").first()
    x = [row[c] for c in names]
    got = phi.filter("id = 17").first()
    for j, name in enumerate(names):
        want = 0.0
        others = [k for k in range(3) if k != j]
        for size in range(3):
            for s in itertools.combinations(others, size):
                w = math.factorial(size) * math.factorial(2 - size) / math.factorial(3)
                want += w * (tree_value(leaves, x, {*s, j}) - tree_value(leaves, x, set(s)))
        assert got[name] == pytest.approx(want, abs=1e-9)
    importance = TR.impurity_importance(model, frame, names)
    assert importance.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    by_gain = {r.feature: r.importance for r in TR.gain_importance(model, frame, names).collect()}
    assert {r.feature: r.importance for r in importance.collect()} == pytest.approx(by_gain)
    score = phi.join(model.transform(frame).select("id", "prediction"), "id").select(F.max(F.abs(F.col("prediction") - F.col("tree_prediction"))))
    assert score.first()[0] < 1e-9


def test_path_attributions_agree_with_enumeration_on_deep_trees():
    """Random trees that split on the same features again and again."""
    rng = np.random.default_rng(2)
    width = 4
    for _ in range(12):
        feature, cut, left, right, share, value = [], [], [], [], [], []

        def grow(depth, part):
            i = len(feature)
            for column, v in zip((feature, cut, left, right, share, value), (-1, 0.0, -1, -1, part, rng.normal())):
                column.append(v)
            if depth and rng.random() < 0.85:
                feature[i], cut[i] = int(rng.integers(0, width)), rng.normal()
                p = rng.uniform(0.1, 0.9)
                left[i] = grow(depth - 1, p)
                right[i] = grow(depth - 1, 1 - p)
            return i

        roots = np.array([grow(6, 1.0), grow(3, 1.0)])
        arrays = [np.array(a) for a in (feature, cut, left, right, share, value)]
        x = rng.normal(size=(5, width))
        got = TR.path_attributions(x, (roots, *arrays), width)

        def expected(i, row, known):
            if feature[i] < 0:
                return value[i]
            j = feature[i]
            if j in known:
                return expected(left[i] if row[j] <= cut[i] else right[i], row, known)
            return share[left[i]] * expected(left[i], row, known) + share[right[i]] * expected(right[i], row, known)

        for row, phi in zip(x, got):
            worth = {s: sum(expected(r, row, s) for r in roots) for n in range(width + 1) for s in itertools.combinations(range(width), n)}
            assert phi[width] == pytest.approx(worth[tuple(range(width))])
            for j in range(width):
                want = 0.0
                for s, v in worth.items():
                    if j not in s:
                        weight = math.factorial(len(s)) * math.factorial(width - len(s) - 1) / math.factorial(width)
                        want += weight * (worth[tuple(sorted((*s, j)))] - v)
                assert phi[j] == pytest.approx(want, abs=1e-9)


def test_local_explanations_keep_the_largest(spark):
    df = spark.createDataFrame([(1, 0.1, -5.0, 2.0)], "k int, a double, b double, c double")
    got = [(r.feature, r.place) for r in A.local_explanations(df, ["a", "b", "c"], ["k"], top=2).orderBy("place").collect()]
    assert got == [("b", 1), ("c", 2)]


def test_task_functions_need_no_package_on_executors():
    data = cloudpickle.dumps(TR.path_attributions)
    code = "import sys, pickle; assert callable(pickle.loads(sys.stdin.buffer.read())); assert 'terrapanel' not in sys.modules"
    subprocess.run([sys.executable, "-I", "-c", code], input=data, cwd="/", check=True)


@pytest.mark.parametrize("kind,grid", [
    ("forest", {"numTrees": [2, 5], "maxDepth": [2, 3]}), ("boosted", {"maxIter": [1, 4], "stepSize": [0.1, 0.5], "maxDepth": [2]}),
])
def test_search_by_prefixes_scores_the_smaller_ensembles(frame, kind, grid):
    """The first trees of a fitted ensemble against ensembles fitted at that size, fold by fold."""
    names, df = ["a", "b", "c"], frame.withColumn("fold", (F.col("id") % 3).cast("int"))
    best, results = TR.search_by_prefixes(df, names, "y", kind, grid, "fold", 3)
    assert len(results) == 4
    for setting, got in results:
        errors = []
        for f in range(3):
            model = TR.fit_ensemble(df.filter(F.col("fold") != f), names, "y", kind, **setting)
            rest = model.transform(df.filter(F.col("fold") == f))
            errors.append(rest.agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0])
        assert got == pytest.approx(np.sqrt(np.mean(errors)), rel=1e-9 if kind == "boosted" else 0.15), setting
    low = min(results, key=lambda r: r[1])[0]
    assert len(best.stages[-1].treeWeights) == low[TR._SIZES[kind]]


def test_search_fits_side_by_side_on_evenly_dealt_rows(spark, frame, monkeypatch):
    """Two fits meet at a barrier, and a table of one partition is dealt to as many as tasks can run at once."""
    meet, parts, inner = threading.Barrier(2), [], TR._prefix_errors

    def held(model, rest, *args):
        parts.append(rest.select(F.spark_partition_id().alias("p")).distinct().count())
        meet.wait(120)
        return inner(model, rest, *args)

    monkeypatch.setattr(TR, "_prefix_errors", held)
    df = frame.withColumn("fold", (F.col("id") % 2).cast("int")).coalesce(1)
    _, results = TR.search_by_prefixes(df, ["a", "b", "c"], "y", "boosted", {"maxIter": [2], "maxDepth": [2]}, "fold", 2)
    assert len(results) == 1 and parts == [spark.sparkContext.defaultParallelism] * 2


def test_consensus_of_models(spark, frame):
    """Consensus and selection recomputed from the methods' scores."""
    names = ["a", "b", "c", "noise"]
    df = frame.withColumn("noise", F.rand(4))
    options = {"forest": {"numTrees": 5, "maxDepth": 3}, "boosted": {"maxIter": 4, "maxDepth": 2}}
    scores = SE.method_scores(df, names, "y", ["id"], **options).collect()
    by = {(r.method, r.feature): r.importance for r in scores}
    assert set(by) == {(m, f) for m in SE.MODEL_METHODS for f in names}
    table, selected = SE.select_by_consensus(df, names, "y", ["id"], 0.9, 2, 3, **options)
    for r in table.collect():
        shares = [by[m, r.feature] / max(by[m, f] for f in names) for m in SE.MODEL_METHODS]
        assert r.mean_importance == pytest.approx(np.mean(shares), rel=1e-9) and r.std_importance == pytest.approx(np.std(shares), rel=1e-9)
        assert r.methods_count == sum(s > 0 for s in shares) and 0 <= r.correlation <= 1
    ordered = sorted(table.collect(), key=lambda r: -r.mean_importance)
    share = np.cumsum([r.mean_importance for r in ordered]) / sum(r.mean_importance for r in ordered)
    size = min(3, max(2, int((share <= 0.9).sum())))
    assert [r.feature for r in selected.orderBy("rank").collect()] == [r.feature for r in ordered[:size]]
    assert ordered[-1].feature == "noise"


def test_model_comparison_by_hand(spark):
    """Scores of two sets of predictions on two splits, against plain formulas."""
    rng = random.Random(8)
    rows = [("train" if i % 3 else "validation", rng.gauss(0, 1)) for i in range(90)]
    base = spark.createDataFrame([(s, y, y + rng.gauss(0, 0.3), 0.2) for s, y in rows], "split string, y double, p double, q double")
    scored = {"good": base.withColumn("prediction", F.col("p")), "flat": base.withColumn("prediction", F.col("q"))}
    got = {tuple(r)[0]: r.asDict() for r in L.model_comparison(scored, "y", {"good": 0.5, "flat": 1.5}).collect()}
    table = np.array([(r.split == "train", r.y, r.p, r.q) for r in base.collect()], float)
    for name, col in (("good", 2), ("flat", 3)):
        numbers = [v for v in got[name].values() if isinstance(v, float)]
        for flag in (1.0, 0.0):
            y, p = table[table[:, 0] == flag, 1], table[table[:, 0] == flag, col]
            r2 = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
            for want in (r2, np.sqrt(((y - p) ** 2).mean()), np.abs(y - p).mean()):
                assert any(v == pytest.approx(want) for v in numbers), (name, want, got[name])
