"""Structure reports, column lists and modes on hand-made tables."""

from terrapanel.operators import encoding as E
from terrapanel.operators import panel as P
from terrapanel.operators import profile as PR
from terrapanel.operators import quality as Q
from terrapanel.operators.quantiles import modes

NAMES = (
    "grid_id city_name year month elec_kwh ln_elec_kwh prec wind population canopy_share days_in_bin_0_5 days_in_bin_0_5_x_canopy "
    "canopy_category extreme_hot_days gdp_category season_spring canopy_x_gdp odd"
).split()


def test_structure_groups_are_not_the_selectors(spark):
    df = spark.createDataFrame([tuple(range(len(NAMES)))] * 3, NAMES)
    got = {r.column_group: (r.n_columns, r.total_rows, r.total_columns) for r in PR.dataset_structure(df).collect()}
    want = {
        "temperature_bins": 1, "temperature_interactions": 1, "canopy_variables": 3, "climate_variables": 2, "socioeconomic_variables": 1,
        "spatial_variables": 2, "temporal_variables": 2, "target_variables": 2,
    }
    assert got == {g: (n, 3, len(NAMES)) for g, n in want.items()}
    own = PR.structure_report(df)
    assert own["canopy"] == ["canopy_share", "canopy_category"] and own["interactions"] == ["canopy_x_gdp"]
    assert own["other"] == ["grid_id", "odd"] and own["climate_raw"] == ["prec", "wind"] and own["seasonal"] == ["season_spring"]
    assert PR.structure_report(df, "grid")["spatial"] == ["grid_id"]


def test_columns_left_out(spark):
    df = spark.createDataFrame([tuple(range(len(NAMES)))], NAMES)
    assert set(NAMES) - set(E.drop_redundant(df).columns) == {"canopy_category", "gdp_category"}
    assert E.drop_redundant(E.drop_redundant(df)).columns == E.drop_redundant(df).columns
    assert not {"grid_id", "city_name", "elec_kwh", "ln_elec_kwh"} & set(PR.predictor_columns(df, "grid"))
    assert "grid_id" in PR.predictor_columns(df, "city")
    renamed = P.rename_columns(df, {"odd": "even", "absent": "x"})
    assert "even" in renamed.columns and "x" not in renamed.columns and len(renamed.columns) == len(NAMES)
    assert P.drop_if_present(df, ["odd", "absent"]).columns == [c for c in NAMES if c != "odd"]
    shared, first, second = PR.shared_columns(df, df.drop("odd").withColumnRenamed("wind", "air"))
    assert first == ["odd", "wind"] and second == ["air"] and len(shared) == len(NAMES) - 2


def test_modes_and_required_columns(spark):
    df = spark.createDataFrame([(1, "b", None), (1, "a", None), (2, "b", None), (2, "a", None), (None, None, None)], "x int, y string, z double")
    assert sorted(tuple(r) for r in modes(df, ["x", "y", "z"]).collect()) == [("x", "1", 2), ("y", "a", 2)]
    assert Q.required_columns(df, ["x", "q"]).first().passed is False
    counts, missing, ranges = Q.feature_validation(df, ["x"])
    assert {r.variable: r.null_count for r in missing.collect()} == {"x": 1, "y": 1, "z": 5} and ranges.first()["max"] == 2.0
    assert {r.column_group: r.n_columns for r in counts.collect()} == {"other": 3}
