"""The regression family against dense least squares, and sweeps of several large effects."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import fixed_effects as FE
from terrapanel.plans import regression_queries as RQ

BINS = ["below_neg10", "neg10_neg5", "neg5_0", "0_5", "5_10", "10_15", "15_20", "20_25", "25_30", "30_35", "35_40", "40_plus"]


@pytest.fixture(scope="module")
def located(spark):
    rng = random.Random(12)
    rows = []
    for g in range(14):
        for year in (2012, 2013, 2014, 2015):
            for month in range(1, 13):
                if rng.random() < 0.1:
                    continue
                days = [0] * 12
                for _ in range(30):
                    days[min(11, max(0, int(rng.gauss(6, 3))))] += 1
                canopy = rng.random() * (g % 5) / 5
                y = math.exp(0.02 * days[9] * (1 - canopy) + 0.1 * g + 0.05 * year % 3 + rng.gauss(0, 0.3))
                light = None if g == 3 and month == 2 else float(rng.randint(0, 9))
                rows.append((g, year, month, y, canopy, rng.randint(1, 99), light, rng.uniform(50, 95), 100 + g * 0.35, 30 + (g % 4) * 0.4, *days))
    schema = "grid_id int, year int, month int, elec_kwh double, canopy_share double, population int, nightlight double, rhu double, lon double, lat double, "
    return spark.createDataFrame(rows, schema + ", ".join(f"days_in_bin_{b} int" for b in BINS)).repartition(4).cache()


def dense(table, subset, regressors):
    """Estimates and errors over distance of one model from its rows as numpy arrays."""
    rows = [r for r in table if (subset is None or r[subset]) and all(r[x] is not None for x in regressors)]
    col = lambda c: np.array([float(r[c]) for r in rows])
    effects = np.column_stack([(col(e) == v).astype(float) for e in ("grid_id", "year", "month") for v in np.unique(col(e))])
    sweep = lambda m: m - effects @ np.linalg.lstsq(effects, m, rcond=None)[0]
    raw = np.column_stack([col(x) for x in regressors])
    x, y = sweep(raw), sweep(col("ln_elec_kwh"))
    kept = []
    for j in range(x.shape[1]):
        size = (raw[:, j] ** 2).sum()
        if (x[:, j] ** 2).sum() <= 1e-9 * size:
            continue
        rest = x[:, j] - (x[:, kept] @ np.linalg.lstsq(x[:, kept], x[:, j], rcond=None)[0] if kept else 0)
        if (rest**2).sum() > 1e-9 * (x[:, j] ** 2).sum():
            kept.append(j)
    x = x[:, kept]
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    s = x * (y - x @ b)[:, None]
    lon, lat = col("lon"), col("lat")
    near = 111.0 * np.hypot(lat[:, None] - lat, np.cos(np.radians((lat[:, None] + lat) / 2)) * (lon[:, None] - lon)) <= 100
    levels = sum(len(np.unique(col(e))) for e in ("grid_id", "year", "month")) - 2
    bread = np.linalg.inv(x.T @ x)
    v = bread @ (s.T @ near @ s) @ bread * (len(rows) - 1) / (len(rows) - levels - len(kept))
    return [regressors[j] for j in kept], b, np.sqrt(np.diag(v)), len(rows)


def test_ten_models_agree_with_dense_least_squares(located):
    df, subsets = RQ.regression_table(located)
    table = [r.asDict() for r in df.withColumns(subsets).collect()]
    fits = RQ.fit_regressions(located, vcov="conley")
    assert list(fits) == list(RQ.MODELS) and len(fits) == 10
    for name, m in RQ.MODELS.items():
        terms, estimates, errors, n = dense(table, m.rows, list(m.regressors))
        fit = fits[name]
        assert fit.terms == terms and fit.n == n, name
        assert set(fit.dropped) == set(m.regressors) - set(terms)
        assert fit.estimates == pytest.approx(estimates, rel=1e-6, abs=1e-9), name
        assert fit.errors == pytest.approx(errors, rel=1e-6, abs=1e-9), name
    assert len({fits[n].n for n in ("model_1", "low_canopy", "high_canopy", "high_humidity", "low_humidity")}) == 5


def test_models_with_other_missing_values_use_their_own_rows(spark):
    rng = random.Random(3)
    rows = [(i % 6, i // 6, rng.gauss(0, 1), None if i % 5 == 0 else rng.gauss(0, 1), math.nan if i % 7 == 0 else rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(120)]
    df = spark.createDataFrame(rows, "g int, t int, y double, a double, b double, c double")
    models = {"a": FE.Model(("a", "c")), "b": FE.Model(("b", "c")), "c": FE.Model(("c",)), "all": FE.Model(("a", "b", "c"))}
    family = FE.fit_family(df, "y", models, ["g"], vcov="hetero")
    for name, m in models.items():
        alone = FE.fixed_effects_ols(df, "y", m.regressors, ["g"], vcov="hetero")
        assert family[name].n == alone.n
        assert family[name].estimates == pytest.approx(alone.estimates) and family[name].errors == pytest.approx(alone.errors)
    assert len({f.n for f in family.values()}) == 4


@pytest.mark.parametrize("effects", [["g", "t"], ["g", "t", "h"]])
def test_conjugate_gradients_remove_several_effects(spark, effects):
    """Sparse links between levels, where plain alternation is slow."""
    rng = random.Random(8)
    rows = [(i % 40, (i % 40 + rng.choice([0, 0, 0, 1])) % 40, rng.randrange(15), rng.gauss(i % 3, 1), rng.gauss(0, 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, t int, h int, a double, y double")
    work, rounds = FE.sweep(df, [[e] for e in effects], ["a", "y"])
    got = np.array(sorted((r.g, r.t, r.h, r.a, r.y) for r in work.select("g", "t", "h", "a", "y").collect())) if len(effects) == 3 else None
    table = np.array(rows, float)
    d = np.column_stack([(table[:, "gth".index(e)] == v).astype(float) for e in effects for v in np.unique(table[:, "gth".index(e)])])
    want = table[:, 3:] - d @ np.linalg.lstsq(d, table[:, 3:], rcond=None)[0]
    gram = work.select((F.col("a") * F.col("a")).alias("aa"), (F.col("a") * F.col("y")).alias("ay"), (F.col("y") * F.col("y")).alias("yy"))
    sums = gram.agg(F.sum("aa"), F.sum("ay"), F.sum("yy")).first()
    assert list(sums) == pytest.approx([want[:, 0] @ want[:, 0], want[:, 0] @ want[:, 1], want[:, 1] @ want[:, 1]], rel=1e-8, abs=1e-8)
    assert 0 < rounds < 100
    if got is not None:
        assert np.sort(got[:, 3]) == pytest.approx(np.sort(want[:, 0]), abs=1e-7)


def test_effects_inside_clusters_need_not_count(spark):
    rng = random.Random(4)
    rows = [(g, t, g // 3, rng.gauss(0, 1), rng.gauss(0, 1)) for g in range(12) for t in range(6)]
    df = spark.createDataFrame(rows, "g int, t int, c int, x double, y double")
    full = FE.fixed_effects_ols(df, "y", ["x"], ["g", "t"], vcov="cluster", cluster="c")
    fewer = FE.fixed_effects_ols(df, "y", ["x"], ["g", "t"], vcov="cluster", cluster="c", count_nested=False)
    n = len(rows)
    assert full.parameters == 12 + 6 - 1 + 1
    assert (full.errors[0] / fewer.errors[0]) ** 2 == pytest.approx((n - 7) / (n - 18))


def test_one_large_effect_is_swept_inside_tasks(spark, monkeypatch):
    """No stored or joined stack, and the same fit where levels are too large for a task, which spreads them."""
    rng = random.Random(6)
    rows = [(f"g{g}", t % 5, g % 3, rng.gauss(g, 1), rng.gauss(0, 1)) for g in range(9) for t in range(2 + 4 * g)]
    df = spark.createDataFrame(rows, "g string, t int, c int, x double, y double").repartition(3)
    table = np.array([(int(g[1:]), t, x, y) for g, t, _, x, y in rows])
    d = np.column_stack([(table[:, j] == v).astype(float) for j in (0, 1) for v in np.unique(table[:, j])])
    x, y = (v - d @ np.linalg.lstsq(d, v, rcond=None)[0] for v in table[:, 2:].T)

    def refuse(*args, **kwargs):
        raise AssertionError("stacked rows are joined to their means")

    stored, keep = [], FE.checkpointed
    monkeypatch.setattr(FE, "demean", refuse)
    monkeypatch.setattr(FE, "checkpointed", lambda df: stored.append(df.columns) or keep(df))
    errors = []
    for held, batch in ((1 << 15, 1), (8, 16)):
        monkeypatch.setattr(FE, "HELD_ROWS", held)
        monkeypatch.setattr(FE, "BATCH_ROWS", batch)
        fit = FE.fixed_effects_ols(df, "y", ["x"], ["g", "t"], vcov="cluster", cluster="c")
        assert fit.estimates == pytest.approx([x @ y / (x @ x)], rel=1e-9) and fit.n == len(rows)
        errors.append(fit.errors[0])
    assert errors[0] == pytest.approx(errors[1], rel=1e-9)
    assert len(stored) == 2 and not any("grp" in columns for columns in stored)
