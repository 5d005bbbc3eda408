import pytest
from pyspark.sql import functions as F

from terrapanel.operators.panel import temporal_split
from terrapanel.sources import readers as R
from terrapanel.sources import schemas, sinks


def test_schemas_have_the_expected_width():
    assert len(schemas.GRID_PANEL) == 47
    assert len(schemas.CITY_PANEL) == 41


def test_city_list_with_bom_and_sparse_province(spark, tmp_path):
    path = tmp_path / "cities.csv"
    path.write_text("City,Province\nA,P1\nB,\nC,P2\nD,\n", encoding="utf-8-sig")
    got = [(r.City, r.Province) for r in R.city_list(spark, str(path)).orderBy("line_no").collect()]
    assert got == [("A", "P1"), ("B", "P1"), ("C", "P2"), ("D", "P2")]


def test_panel_round_trip_and_missing_path(spark, tmp_path):
    df = spark.createDataFrame([("1_2", 2012, 1, float("nan")), ("1_3", 2013, 2, 4.0)], "grid_id string, year int, month int, v double")
    path = str(tmp_path / "panel")
    sinks.write_panel(df, path)
    got = {r.grid_id: r.v for r in R.grid_panel(spark, path).collect()}
    assert got == {"1_2": None, "1_3": 4.0}
    plan = spark.read.parquet(path).filter("year = 2012")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    with pytest.raises(FileNotFoundError):
        R.grid_panel(spark, str(tmp_path / "nowhere"))
    found, missing = R.optional_sources(spark, {"panel": path, "gone": str(tmp_path / "x")})
    assert list(found) == ["panel"] and missing == ["gone"]


def test_city_panel_derives_its_id(spark, tmp_path):
    path = str(tmp_path / "city")
    df = spark.createDataFrame([("X", 2012, 1, 5.0, "P")], "city_name string, year int, month int, elec_kwh double, province string")
    sinks.write_csv(df, path)
    got = R.city_panel(spark, path, df.schema).first()
    assert got.city_id == "X_P" and got.elec_kwh == 5.0


def test_splits_features_sample_and_metadata(spark, tmp_path):
    df = temporal_split(spark.createDataFrame([(2012, 1.0), (2018, 2.0), (2030, 9.0)], "year int, v double"))
    sinks.write_splits(df, str(tmp_path / "s"))
    assert [r.year for r in sinks.read_split(spark, str(tmp_path / "s"), "validation").collect()] == [2018]
    ranked = spark.createDataFrame([("b", 2), ("a", 1)], "feature string, rank int")
    sinks.write_selected(ranked, str(tmp_path / "f"))
    assert sinks.read_selected(spark, str(tmp_path / "f")) == ["a", "b"]
    sinks.write_sample(df.drop("split"), str(tmp_path / "h"), ["year"], 2)
    assert spark.read.option("header", True).csv(str(tmp_path / "h")).count() == 2
    sinks.write_metadata(df, str(tmp_path / "m"), ["v"])
    meta = spark.read.json(str(tmp_path / "m")).first()
    assert meta.total_observations == 3 and meta.v.mean == 4.0


def test_period_of_scanned_file(spark, tmp_path):
    spark.range(2).coalesce(1).write.parquet(str(tmp_path / "x"))
    part = next(p for p in (tmp_path / "x").iterdir() if p.suffix == ".parquet")
    data = part.read_bytes()
    (tmp_path / "t2m_2015_7.parquet").write_bytes(data)
    got = R.with_file_period(spark.read.parquet(str(tmp_path / "t2m_2015_7.parquet")), "year_and_month").first()
    assert got is not None and (got.year, got.month) == (2015, 7)


def test_raster_and_cube_scans(spark, tmp_path):
    cells = spark.createDataFrame([("gdp", "2012", 23, 0, 0, 1.0), ("gdp", "2013", 24, 0, 0, 2.0)], schemas.RASTER_CELL)
    cells.write.partitionBy("period").parquet(str(tmp_path / "r"))
    assert R.raster_cells(spark, str(tmp_path / "r"), "2013").first().value == 2.0
    assert R.raster_band(cells, 2012).first().value == 1.0
    month = spark.createDataFrame([("prec", 2011, 1, 0.0, 0.0, 1.0), ("prec", 2012, 1, 0.0, 0.0, 2.0)], schemas.GRIDDED_MONTH)
    month.write.parquet(str(tmp_path / "g"))
    assert [r.value for r in R.gridded_month(spark, str(tmp_path / "g"), "prec").collect()] == [2.0]
    cube = spark.sql("SELECT TIMESTAMP_NTZ'2012-01-31 20:00:00' valid_time, 1.0D latitude, 2.0D longitude, 300.0D t2m, 290.0D d2m")
    cube.write.parquet(str(tmp_path / "c"))
    row = R.hourly_cube(spark, str(tmp_path / "c")).first()
    assert row.t2m == pytest.approx(26.85) and row.local_time.day == 1
    ring = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (1, 0), (0, 1))])
    sinks.write_boundaries(spark.range(1).select(F.lit("A").alias("ADM2_EN"), ring.alias("ring")), str(tmp_path / "b"))
    assert len(R.boundaries(spark, str(tmp_path / "b")).first().edges) == 3


def test_trial_subset(spark):
    df = spark.range(20).select((F.col("id") % 5).alias("grid_id"), F.lit(2012).alias("year"), (F.floor(F.col("id") / 5) + 1).alias("month"))
    assert R.subset(df, periods=2, entities=3).count() == 6
