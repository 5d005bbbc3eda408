import math

import pytest
from pyspark.sql import functions as F

from terrapanel.functions import bins as B
from terrapanel.functions import distributions as D
from terrapanel.functions import scalars as S
from terrapanel.sources.readers import period_from_name


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_temperature_bins_edges(spark):
    values = [-50.1, -50.0, -10.0, -0.0, 40.0, 50.1, None, float("nan")]
    df = S.nan_to_null(spark.createDataFrame([(v,) for v in values], "v double"))
    row = df.agg(*B.bin_counts(F.col("v"), B.TEMPERATURE_BINS)).first().asDict()
    assert row["days_in_bin_below_neg10"] == 1  # -50; -50.1 is under the floor
    assert row["days_in_bin_neg10_neg5"] == 1
    assert row["days_in_bin_0_5"] == 1
    assert row["days_in_bin_40_plus"] == 2
    assert sum(row.values()) == 5


def test_labels_of_missing_values_are_unknown(spark):
    df = spark.createDataFrame([(None,), (39.999,), (70.0,), (500.0,), (-1.0,)], "v double")
    got = [r[0] for r in df.select(B.bin_label(F.col("v"), B.HUMIDITY_BINS)).collect()]
    assert got == ["unknown", "RH_low", "RH_high", "RH_high", "unknown"]


def test_zero_then_breaks(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.3,), (0.31,), (None,)], "v double")
    got = [r[0] for r in df.select(B.zero_then_breaks(F.col("v"), "no", B.CANOPY_BREAKS, "high")).collect()]
    assert got == ["no", "low_canopy", "medium_canopy", "high", "unknown"]


def test_nodata_becomes_null(spark):
    df = spark.createDataFrame([(1.0, -99.0), (float("nan"), 2.0)], "a double, b double")
    rows = S.nan_to_null(df, {"b": -99.0}).collect()
    assert rows[0].b is None and rows[1].a is None and rows[1].b == 2.0


def test_joined_label_needs_every_part(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "x string, y string")
    assert [r[0] for r in df.select(S.joined_label("x", "y")).collect()] == ["a_b", None]


def test_hours_in_year(spark):
    assert [one(spark, S.hours_in_year(F.lit(y))) for y in (2023, 2024, 1900, 2000)] == [8760, 8784, 8760, 8784]


def test_entropy_matches_hand_computation(spark):
    df = spark.createDataFrame([(10, 0, 20, None)], "a int, b int, c int, d int")
    total = S.row_sum("abcd")
    got = df.select(total.alias("t"), S.row_entropy("abcd", total).alias("h")).first()
    shares = [10 / (30 + 1e-6), 1e-6, 20 / (30 + 1e-6)]
    assert got.t == 30.0
    assert got.h == pytest.approx(-sum(s * math.log(s) for s in shares))


@pytest.mark.parametrize("lon,lat", [(73.5, 18.2), (105.0, 35.0), (134.7, 53.4), (121.47, 31.23)])
def test_albers_inverse(spark, lon, lat):
    p = S.AlbersProjection()
    x, y = p.forward(lon, lat)
    got_lon, got_lat = p.to_lonlat(F.lit(x), F.lit(y))
    assert one(spark, got_lon) == pytest.approx(lon, abs=1e-9)
    assert one(spark, got_lat) == pytest.approx(lat, abs=5e-8)


def test_file_name_periods(spark):
    cases = [
        ("year_month", "201203.tif", {"year": 2012, "month": 3}),
        ("tagged_year", "cover_A2012_v4.tif", {"year": 2012}),
        ("year_and_month", "t2m_2015_7.nc", {"year": 2015, "month": 7}),
        ("month_only", "light_11.tif", {"month": 11}),
        ("year_month", "readme.txt", {"year": None, "month": None}),
    ]
    for rule, name, want in cases:
        got = {k: one(spark, c) for k, c in period_from_name(F.lit(name), rule).items()}
        assert got == want


def test_student_tail_probabilities():
    # two-sided 5 % points of the t distribution
    for df, t in ((1, 12.7062), (5, 2.5706), (30, 2.0423), (1000, 1.9623)):
        assert D.t_two_sided_p(t, df) == pytest.approx(0.05, abs=2e-5)
    assert D.t_two_sided_p(0.0, 7) == pytest.approx(1.0)
    assert [D.stars(p) for p in (0.0001, 0.005, 0.03, 0.2, None)] == ["***", "**", "*", "", ""]
