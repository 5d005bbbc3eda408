"""Mutual information by nearest neighbours against comparing all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import neighbours as N


def brute(x, y, k=3, scale=None):
    # Equal gaps on a grid are equal or not by the last digit of the scale, so it is that of the run under test.
    sx, sy = scale or (np.std(x), np.std(y))
    x, y = np.array(x) / sx, np.array(y) / sy
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, axis=1)[:, k - 1 : k]
    nx = ((dx < r) | (dx == 0)).sum(1) - 1
    ny = ((dy < r) | (dy == 0)).sum(1) - 1
    psi = N.digamma
    mi = psi(np.array([float(len(x))]))[0] + psi(np.array([float(k)]))[0] - np.mean(psi(nx + 1.0) + psi(ny + 1.0))
    return max(0.0, mi), r[:, 0]


def test_digamma():
    assert N.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-13)
    assert N.digamma(np.array([0.5]))[0] == pytest.approx(-1.9635100260214235, abs=1e-13)
    x = np.linspace(0.3, 60, 200)
    assert N.digamma(x + 1) - N.digamma(x) == pytest.approx(1 / x, rel=1e-10)


@pytest.mark.parametrize("cell, n", [(40, 600), (2000, 2000)])
def test_information_agrees_with_all_pairs(spark, cell, n):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        a = rng.gauss(0, 1)
        y = a + rng.gauss(0, 0.5)
        rows.append((a, float(rng.randint(0, 4)), y * y + rng.gauss(0, 1) if i % 3 else 2.0, rng.lognormvariate(0, 2), y))
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0, 1.0), (1.0, math.nan, 1.0, 1.0, None)], "a double, b double, c double, d double, y double")
    got = {r.feature: r.importance for r in N.neighbour_information(df.limit(n), ["a", "b", "c", "d"], "y", cell=cell).collect()}
    for j, name in enumerate("abcd"):
        scale = df.limit(n).agg(F.stddev_pop(name), F.stddev_pop("y")).first()
        want, _ = brute([r[j] for r in rows], [r[4] for r in rows], scale=tuple(scale))
        assert got[name] == pytest.approx(want, abs=1e-9), name
    assert got["a"] > 0.5 > got["d"]


def test_degenerate_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 5 + [(2.0, 3.0)] * 4 + [(None, 1.0)], "x double, y double")
    x, y = [1.0] * 5 + [2.0] * 4, [2.0] * 5 + [3.0] * 4
    assert N.neighbour_information(df, ["x"], "y").first().importance == pytest.approx(brute(x, y)[0], abs=1e-12)
    assert N.neighbour_information(df.limit(2), ["x"], "y").first().importance == 0.0
    assert N.neighbour_information(df.filter("x = 1"), ["x"], "y").first().importance == 0.0
    assert N.neighbour_information(df.limit(0), ["x"], "y").first().importance == 0.0


def test_axis_values_are_copied_only_for_strips_with_many_questions(spark, monkeypatch):
    """2,000 values in strips of 2: a value is copied once for every 200 questions that its own strip gets."""
    from pyspark.sql import GroupedData

    rows = []
    asked = GroupedData.cogroup
    monkeypatch.setattr(GroupedData, "cogroup", lambda held, other: rows.append(held._df.count()) or asked(held, other))
    points = spark.range(2_000).select("id", (F.col("id") * 1.0).alias("x"), F.lit(1).cast("long").alias("w"))
    for radius, most in ((2.5, 2_100), (5_000.0, 2_100)):
        got = N.axis_counts(points.withColumn("r", F.lit(radius)), "x", "n", strip=2)
        found = {r.id: r.n for r in got.collect()}
        reach = int(radius)
        assert found == {i: min(1_999, i + reach) - max(0, i - reach) for i in range(2_000)}
        assert rows.pop() <= most


def test_nearest_points_agree_with_all_pairs():
    import pandas as pd

    rng = np.random.default_rng(3)
    for n, asked in ((1, 1), (3, 5), (700, 90), (900, 900)):
        p = pd.DataFrame({"x": rng.integers(0, 40, n) + rng.random(n) ** 6, "y": rng.normal(size=n) ** 3, "w": rng.integers(1, 3, n)})
        q = p if n == asked else pd.DataFrame({"x": rng.random(asked) * 60, "y": rng.normal(size=asked)})
        d, w = N._nearest(p, q, 3, own=n == asked)
        want = np.maximum(np.abs(p.x.to_numpy() - q.x.to_numpy()[:, None]), np.abs(p.y.to_numpy() - q.y.to_numpy()[:, None]))
        order = np.argsort(want, axis=1, kind="stable")[:, :4]
        assert (d == np.take_along_axis(want, order, 1)).all()
        assert (w == p.w.to_numpy()[order] - (np.arange(min(4, n)) == 0) * (n == asked)).all()
