from pyspark.sql import functions as F

from terrapanel.operators import encoding as E
from terrapanel.operators.events import event_dummies, event_years


def test_tied_quantiles_leave_the_middle_empty(spark):
    df = spark.createDataFrame([(0.0,)] * 9 + [(5.0,)], "v double")
    b = E.QuantileBinner("v", ("Low", "Medium", "High")).fit(df)
    assert b.collapsed == ["Medium"]
    got = {r.l: r.n for r in b.transform(df, "l").groupBy("l").agg(F.count("*").alias("n")).collect()}
    assert got == {"Low": 9, "High": 1}


def test_zero_inflated_without_positives_adds_nothing(spark):
    df = spark.createDataFrame([(0,), (0,)], "v int")
    assert E.ZeroInflatedBinner("v").fit(df).transform(df, "c").columns == ["v"]


def test_dummies_agree_between_splits(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    other = spark.createDataFrame([("b",), ("z",), (None,)], "c string")
    enc = E.OneHot(["c"]).fit(train)
    got = [tuple(r) for r in enc.transform(other).collect()]
    assert enc.transform(train).columns == enc.transform(other).columns == ["c", "c_a", "c_b"]
    assert got == [("b", 0, 1), ("z", 0, 0), (None, 0, 0)]


def test_label_codes(spark):
    train = spark.createDataFrame([("b", "x"), ("a", "y")], "c string, d string")
    val = spark.createDataFrame([("c", "x"), ("q", None)], "c string, d string")
    codes = E.LabelCodes(["c", "d"], max_levels=3).fit(train, val)
    assert codes.dropped == ["c"]
    assert [tuple(r) for r in codes.transform(val).collect()] == [(0,), (2,)]


def test_imputer_learns_on_train(spark):
    train = spark.createDataFrame([(1.0, "a", 1.0), (3.0, None, 2.0), (8.0, "b", None)], "x double, s string, elec_kwh double")
    test = spark.createDataFrame([(None, None, None), (float("nan"), "c", 1.0), (float("inf"), "c", 1.0)], train.schema)
    got = [tuple(r) for r in E.Imputer().fit(train).transform(test).collect()]
    assert got == [(3.0, "missing", None), (3.0, "c", 1.0), (0.0, "c", 1.0)]


def test_product_rules_need_both_inputs(spark):
    df = spark.createDataFrame([(0.5, 1)], "extreme_hot_share double, gdp_high_gdp int")
    assert E.product_features(df).columns[2:] == ["hot_days_x_high_gdp"]


def test_event_timing(spark):
    rows = [("a", y, v) for y, v in ((2012, 10.0), (2013, 11.0), (2014, 17.0), (2015, 30.0))] + [("b", 2012, 1.0), ("b", 2014, 50.0)]
    df = spark.createDataFrame(rows, "g string, year int, canopy double")
    events = event_years(df, "g", "canopy")
    assert [tuple(r) for r in events.collect()] == [("a", 2014)]
    out = {(r.g, r.year): r for r in event_dummies(df, "g", events).collect()}
    assert out[("a", 2012)].event_m2 == 1 and out[("a", 2015)].event_p1 == 1
    assert out[("b", 2014)].relative_year is None and out[("b", 2014)].event_m3 == 0
