import datetime as dt

from pyspark.sql import functions as F

from terrapanel.operators import panel as P
from terrapanel.operators import profile as PR
from terrapanel.operators import quality as Q
from terrapanel.operators import ranking as RK
from terrapanel.operators import rollup as R
from terrapanel.operators import sampling as S
from terrapanel.operators import timeseries as TS


def test_absent_sources_are_reported_and_fill_policies_differ(spark):
    base = spark.createDataFrame([("a", 2012, 1), ("b", 2012, 1)], "grid_id string, year int, month int")
    light = spark.createDataFrame([("a", 2012, 1, 3.0)], "grid_id string, year int, month int, nightlight double")
    canopy = spark.createDataFrame([("a", 2012, 40.0)], "grid_id string, year int, canopy_share double")
    keys = {"l": ["grid_id", "year", "month"], "c": ["grid_id", "year"], "x": ["grid_id"]}
    sources = {"l": light, "c": canopy, "x": None}
    assert P.left_join_sources(base, sources, keys)[1] == ["x"]
    b = P.integrate_panel(base, sources, keys).filter("grid_id = 'b'").first()
    assert b.nightlight == 0.0 and b.canopy_share is None and b.year_month == "2012_01"
    b = P.integrate_panel(base, sources, keys, P.INTENDED_FILL).filter("grid_id = 'b'").first()
    assert b.canopy_share == 0.0


def test_validity_bounds(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (2.0,), (None,), (float("nan"),), (-99.0,)], "v double")
    for column, want in (("elec_kwh", 1), ("nightlight", 2), ("prec", 4)):
        assert P.keep_valid(df.withColumnRenamed("v", column), column).count() == want
    assert P.keep_valid(df.withColumnRenamed("v", "prec"), "prec", nodata=-99.0).count() == 3


def _grid_panel(spark):
    rows = [
        ("1", 2012, 1, "X", "P", 1, 10.0, 5, 0.2), ("2", 2012, 1, "X", "Q", 2, 20.0, 7, 0.4),
        ("3", 2012, 1, None, None, None, 99.0, 1, 0.9), ("4", 2012, 2, "Y", "P", 3, 1.0, 1, None),
    ]
    return spark.createDataFrame(
        rows,
        "grid_id string, year int, month int, city_name string, province string, city_id int, elec_kwh double, "
        "population long, canopy_share double",
    )


def test_city_rollup_by_name_merges_and_by_id_does_not(spark):
    df = _grid_panel(spark)
    by_name = {r.city_name: r for r in R.city_month_panel(df).collect()}
    assert by_name["X"].elec_kwh == 30.0 and by_name["X"].grid_count == 2 and by_name["X"].province == "P"
    assert by_name["Y"].canopy_share is None
    by_id = R.city_month_panel(df, ("city_id", "city_name", "year", "month"))
    assert by_id.count() == 3
    total = by_id.agg(F.sum("elec_kwh")).first()[0]
    assert total == df.filter("city_name is not null").agg(F.sum("elec_kwh")).first()[0]


def test_split_is_disjoint_and_complete(spark):
    df = P.temporal_split(spark.createDataFrame([(y,) for y in range(2011, 2021)], "year int"))
    got = {r.year: r.split for r in df.collect()}
    assert got[2011] is None and got[2017] == "train" and got[2018] == "validation" and got[2019] == "test"
    assert sum(v == "train" for v in got.values()) == 6


def test_local_day_and_strict_month(spark):
    rows = [(dt.datetime(2012, 1, 31, 20), 1.0), (dt.datetime(2012, 1, 31, 10), 2.0), (dt.datetime(2012, 2, 1, 2), 3.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double").withColumn("k", F.lit(1))
    days = {str(r.day): r.daily_max for r in TS.local_daily_max(df, ["k"], "ts", F.col("v")).collect()}
    assert days == {"2012-01-31": 2.0, "2012-02-01": 3.0}
    strict = TS.local_daily_max(df.limit(2), ["k"], "ts", F.col("v"), strict_month=True)
    assert [str(r.day) for r in strict.collect()] == ["2012-01-31"]


def test_annual_replication(spark):
    df = P.replicate_annual(spark.createDataFrame([("a", 2012)], "g string, year int"))
    assert sorted(r.month for r in df.collect()) == list(range(1, 13))


def test_profiles_on_a_single_constant_column(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert PR.informative_numeric(df) == []
    assert [(r.bin, r.n) for r in PR.histogram_counts(df, F.col("v")).collect()] == [(1, 2)]


def test_column_groups_take_the_first_match():
    assert PR.column_group("days_in_bin_0_5_x_canopy") == "temperature_interactions"
    assert PR.column_group("gdp_per_capita") == "socioeconomic_raw"
    assert PR.column_group("gdp_high_gdp") == "socioeconomic_categorical"
    assert PR.column_group("canopy_share") == "canopy"
    assert PR.column_group("something") == "other"
    assert PR.column_group("city_id", "grid") == "location" and PR.column_group("city_id") == "spatial"
    assert PR.column_group("days_in_bin_0_5") == "temperature_bins"
    assert PR.column_group("canopy_x_gdp") == "interactions"


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 5.0), (4, None)], "k int, v double")
    assert [r.k for r in S.extreme_rows(df, "v", "k").collect()] == [3, 1]
    assert [r.k for r in S.extreme_rows(df, "v", "k", largest=False).collect()] == [1, 3]
    assert [r.k for r in RK.top_k(df, "v", 1, key="k").collect()] == [3]
    assert sum(r.n for r in PR.histogram_counts(df, F.col("v"), bins=4).collect()) == 2
    assert PR.missing_profile(df).first().null_count == 2
    assert PR.range_profile(df, ["v"]).first()["max"] == 5.0


def test_shared_columns(spark):
    a, b = spark.range(1).withColumn("x", F.lit(1)), spark.range(1).withColumn("y", F.lit(1))
    assert PR.shared_columns(a, b) == (["id"], ["x"], ["y"])


def test_complete_years_and_manifest(spark):
    full = [(dt.datetime(2012, m, 1),) for m in range(1, 13)] + [(dt.datetime(2013, 5, 1),)]
    df = spark.createDataFrame(full, "ts timestamp_ntz")
    assert {r.year for r in TS.keep_complete_years(df, "ts").collect()} == {2012}
    want = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (1, "c", 7)], "record int, file string, size int")
    have = spark.createDataFrame([(1, "a", 5), (1, "b", 1)], "record int, file string, size int")
    m = Q.reconcile_manifest(want, have)
    assert {r.file: r.state for r in m.collect()} == {"a": "valid", "b": "corrupt", "c": "missing"}
    assert Q.bytes_needed(m).first().bytes_needed == 13


def test_quality_report_marks_missing_years(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 1, 1), 300.0, 73.0, 18.0)], "ts timestamp_ntz, t2m double, lon double, lat double")
    bounds = {"south": 18.0, "north": 18.5, "west": 73.0, "east": 73.5}
    got = {(r.year, r.check): r.passed for r in Q.full_report(df, "ts", [2022, 2023], ["t2m", "d2m"], bounds, {"t2m": Q.KELVIN_RANGE}).collect()}
    assert got[(2022, "file_exists")] is False and got[(2023, "file_exists")] is True
    assert got[(2023, "structure")] is False and got[(2023, "spatial_coverage")] is True
    assert got[(2023, "temporal_coverage")] is False and got[(2023, "quality_t2m")] is True
    assert Q.required_columns(df, ["t2m", "d2m"]).first().passed is False
