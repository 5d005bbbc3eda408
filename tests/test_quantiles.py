import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import correlation as C
from terrapanel.operators import folds as FO
from terrapanel.operators import profile as PR
from terrapanel.operators import quantiles as Q
from terrapanel.operators import sampling as S


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the values are one number; some are missing."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        v = 7.0 if i % 3 == 0 else rng.lognormvariate(0, 3)
        rows.append((i, None if i % 50 == 7 else float("nan") if i % 50 == 9 else v, i % 4))
    return spark.createDataFrame(rows, "k long, v double, g int").repartition(4).cache()


def values(df):
    v = np.array([r["v"] for r in df.select("v").collect() if r["v"] is not None])
    return np.sort(v[~np.isnan(v)])


@pytest.mark.parametrize("limit", [5, 100, 10**6])
def test_exact_quantiles(skewed, limit):
    probs = [0.0, 0.25, 0.33, 0.5, 0.67, 0.999, 1.0]
    got = Q.exact_quantiles(skewed, ["v"], probs, limit=limit)["v"]
    assert got == pytest.approx(np.quantile(values(skewed), probs), rel=1e-12)


@pytest.mark.parametrize("limit", [5, 10**6])
def test_quantiles_by_group(skewed, limit):
    rows = Q.exact_quantiles_by(skewed, ["g"], ["v"], [0.25, 0.5], limit=limit).collect()
    assert len(rows) == 4
    for r in rows:
        want = np.quantile(values(skewed.filter(F.col("g") == r["g"])), [0.25, 0.5])
        assert r["v"] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("limit", [1, 40, 4096])
def test_quantiles_by_many_groups_at_once(spark, limit):
    """Groups from one to thousands of rows, ties, missing values and a null key, in one run."""
    rng = random.Random(6)
    rows = []
    for key, n in ((None, 300), (1, 1), (2, 2), (3, 4000), (4, 50), (5, 7)):
        for i in range(n):
            v = rng.choice([1.0, 2.0, rng.gauss(0, 1e6), rng.random()])
            rows.append((key, v if rng.random() < 0.9 else rng.choice([None, float("nan")]), None if key == 5 else -v if i % 3 else 4.0))
    df = spark.createDataFrame(rows, "g int, v double, w double").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.501, 1.0]
    got = {r["g"]: r for r in Q.exact_quantiles_by(df, ["g"], ["v", "w"], probs, limit=limit).collect()}
    assert set(got) == {None, 1, 2, 3, 4, 5} and got[5]["w"] is None
    for key, r in got.items():
        for c, name in ((1, "v"), (2, "w")):
            mine = [x[c] for x in rows if x[0] == key and x[c] is not None and x[c] == x[c]]
            if mine:
                assert r[name] == pytest.approx(np.quantile(mine, probs), rel=1e-12), (key, name)
            else:
                assert r[name] is None


def test_quantiles_by_group_collect_nothing_that_grows(spark, monkeypatch):
    """Of all groups together the driver sees one row a round."""
    seen = []
    collect = type(spark.range(0)).collect
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda self: seen.append(len(out := collect(self))) or out)
    df = spark.range(4000).select((F.col("id") % 500).alias("g"), F.rand(3).alias("v"))
    out = Q.exact_quantiles_by(df, ["g"], ["v"], [0.5])
    assert all(n <= 1 for n in seen) and out.count() == 500


def test_gathering_is_bounded_in_total():
    assert Q._bounded(list("abcde"), [3, 3, 3, 9, 1], 6) == [["a", "b"], ["c"], ["d"], ["e"]]
    assert Q._bounded([], []) == []


def test_box_statistics_by_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), rng.choice([rng.gauss(0, 1), rng.gauss(0, 9), None, float("nan")]), rng.random()) for _ in range(600)]
    df = spark.createDataFrame(rows + [(3, None, 1.0)], "year int, v double, w double")
    got = {(r.year, r.variable): r for r in PR.box_statistics(df, ["v", "w"]).collect()}
    assert (3, "v") not in got and len(got) == 7
    for key in (1, 2, None):
        mine = np.array([v for k, v, _ in rows if k == key and v is not None and v == v])
        q1, mid, q3 = np.quantile(mine, [0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        r = got[key, "v"]
        assert (r.q25, r.median, r.q75) == pytest.approx((q1, mid, q3))
        assert (r.whisker_low, r.whisker_high, r.outliers) == (mine[mine >= lo].min(), mine[mine <= hi].max(), ((mine < lo) | (mine > hi)).sum())


def test_empty_column(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert Q.exact_quantiles(df, ["v"], [0.5]) == {"v": [None]}


def test_mode_takes_smallest_on_ties(spark):
    df = spark.createDataFrame([(3,), (3,), (1,), (1,), (2,), (None,)], "v int")
    assert Q.mode_value(df, "v") == 1
    assert Q.mode_value(df.filter("v is null"), "v") is None


def test_rank_slice_resolves_ties_by_key(skewed):
    rows = sorted(
        (r["v"], r["k"]) for r in skewed.collect() if r["v"] is not None and not np.isnan(r["v"])
    )
    clean = skewed.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    sevens = next(i for i, r in enumerate(rows) if r[0] == 7.0)
    for start in (0, sevens - 2, sevens + 100, len(rows) - 5):
        got = sorted((r["v"], r["k"]) for r in S.rank_slice(clean, "v", "k", start, start + 5).collect())
        assert got == rows[start : start + 5]


def test_sample_has_exact_size_and_repeats(skewed):
    a = {r["k"] for r in S.sample_rows(skewed, ["k"], 1500).collect()}
    b = {r["k"] for r in S.sample_rows(skewed.repartition(3), ["k"], 1500).collect()}
    assert len(a) == 1500 and a == b
    assert S.sample_rows(skewed, ["k"], 5000).count() == 3000
    assert S.sample_rows(skewed, ["k"], 10).count() == 10


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_forward_fill_across_chunks(spark, chunk):
    data = [None, "a", None, None, None, None, "b", None, "c", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "n int, v string")
    got = [r["v"] for r in S.forward_fill(df, "n", ["v"], chunk).orderBy("n").collect()]
    assert got == [None, "a", "a", "a", "a", "a", "b", "b", "c", "c"]


@pytest.mark.parametrize("chunk", [2, 5, 40])
def test_forward_fill_in_levels(spark, chunk):
    """Sparse and negative line numbers over several levels of chunks; no window without a partition."""
    rng = random.Random(chunk)
    rows = [(n, rng.choice([None, None, None, n]), "x" if n == -150 else None) for n in range(-200, 300) if rng.random() < 0.7 or n == -150]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "n int, v int, w string").repartition(3)
    out = S.forward_fill(df, "n", ["v", "w"], chunk)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    v = w = None
    got = {r.n: (r.v, r.w) for r in out.collect()}
    for n, a, b in sorted(rows):
        v, w = a if a is not None else v, b if b is not None else w
        assert got[n] == (v, w)
    assert S.forward_fill(df.limit(0), "n", ["v"], chunk).count() == 0


@pytest.mark.parametrize("rows_per_range", [40, 10**6])
def test_average_ranks(spark, rows_per_range):
    """A value in a third of the rows, short ties, missing values, in several columns at once."""
    rng = random.Random(rows_per_range)
    rows = []
    for i in range(2000):
        a = 5.0 if i % 3 == 0 else rng.choice([rng.gauss(5, 2), float(rng.randint(0, 9))])
        rows.append((i, a, None if i % 7 == 0 else rng.gauss(0, 1), float("nan") if i % 9 == 0 else float(i % 2), 1.0, None))
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, e double").repartition(4)
    got = C.average_ranks(df, ["a", "b", "c", "d", "e"], rows_per_range).orderBy("k").collect()
    assert [r.k for r in got] == list(range(2000)) and got[0].e is None
    for j, name in enumerate("abcd", 1):
        seen = [r[j] for r in rows if r[j] is not None and r[j] == r[j]]
        ordered = np.sort(seen)
        for r, g in zip(rows, got):
            if r[j] is None or r[j] != r[j]:
                assert g[name] is None
            else:
                lo, hi = np.searchsorted(ordered, r[j], "left"), np.searchsorted(ordered, r[j], "right")
                assert g[name] == (lo + 1 + hi) / 2


def test_folds(spark):
    df = spark.range(103).withColumn("city", F.when(F.col("id") % 10 != 0, F.col("id") % 7))
    sizes = [r["count"] for r in FO.contiguous_folds(df, "id", 5).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [21, 21, 21, 20, 20]
    blocked = FO.entity_folds(df, "city", 5, nulls="block")
    assert blocked.groupBy("city").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert blocked.count() == 103 and FO.entity_folds(df, "city", 5).count() == 92


def test_samples_of_neighbouring_sizes_are_nested(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    small, large = ({r.k for r in S.sample_rows(df, ["k"], n).collect()} for n in (1000, 1001))
    assert len(small) == 1000 and len(large) == 1001 and small < large
