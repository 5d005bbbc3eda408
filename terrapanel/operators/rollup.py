"""Rollups from fine to coarse areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.scalars import columns_matching, month_label
from terrapanel.operators.panel import day_columns, require_key

# How each source behaves when areas are merged. Fixed values.
EXTENSIVE = ("elec_kwh", "population")
INTENSIVE = ("canopy_share", "nightlight", "gdp_per_capita", "prec", "pres", "rhu", "wind", "lon", "lat")


def rollup(
    df: DataFrame,
    keys: Sequence[str],
    how: dict[str, str],
    count_as: str | None = None,
    distinct: dict[str, str] | None = None,
) -> DataFrame:
    """Group by ``keys``; ``how`` maps a column to sum, mean or first.

    'first' takes the smallest value, so it is repeatable. ``distinct`` maps an output name
    to the column whose distinct values it counts.

    Two things would spoil the plan of one plain aggregation over wide rows. A text minimum
    cannot sit in a hash aggregation, so such columns are grouped on first and reduced
    afterwards, when one row per group is left. A distinct count makes Spark shuffle every
    row with all its columns, so it runs beside the sums over its own two or three columns.
    """
    keys = list(keys)
    labels = [c for c, h in how.items() if h == "first"]
    unknown = set(how.values()) - {"sum", "mean", "first"}
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    # Expression text instead of column objects: these lists are long.
    parts = []
    for c, h in how.items():
        if h == "sum":
            parts.append(f"sum(`{c}`) AS `s_{c}`")
        elif h == "mean":
            parts += [f"sum(cast(`{c}` AS double)) AS `s_{c}`", f"count(`{c}`) AS `n_{c}`"]
    if count_as:
        parts.append("count(1) AS n_rows")
    out = df.groupBy(*keys, *labels).agg(*map(F.expr, parts))

    again = "sum" if labels else ""  # a second, tiny aggregation merges the labels of a group
    final = []
    for c, h in how.items():
        if h == "first":
            final.append(f"min(`{c}`) AS `{c}`")
        elif h == "sum":
            final.append(f"{again}(`s_{c}`) AS `{c}`")
        else:
            final.append(f"try_divide({again}(`s_{c}`), {again}(`n_{c}`)) AS `{c}`")
    if count_as:
        final.append(f"{again}(n_rows) AS `{count_as}`")
    out = out.groupBy(*keys).agg(*map(F.expr, final)) if labels else out.selectExpr(*[f"`{k}`" for k in keys], *final)

    for name, column in (distinct or {}).items():
        seen = df.groupBy(*keys).agg(F.count_distinct(column).alias(name))
        seen = seen.withColumnsRenamed({k: f"_k_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        out = out.join(seen, same).drop(*[f"_k_{k}" for k in keys])
    return out


def panel_rollup_rules(df: DataFrame) -> dict[str, str]:
    """Default rule per column of a grid panel, found by name."""
    rules = {c: "sum" for c in EXTENSIVE if c in df.columns}
    if "province" in df.columns:
        rules["province"] = "first"
    for c in (*INTENSIVE, *day_columns(df), *columns_matching(df, contains=("_x_canopy",))):
        if c in df.columns:
            rules[c] = "mean"
    return rules


def city_month_panel(
    grid_panel: DataFrame, keys: Sequence[str] = ("city_name", "year", "month"), unique_rows: bool = False
) -> DataFrame:
    """Grid panel to city panel.

    Grouping by name alone merges cities that share one; pass
    ``("city_id", "city_name", "year", "month")`` to keep them apart. Set ``unique_rows``
    when no grid cell occurs twice in a city and month, as after an integration keyed on
    (grid, year, month): counting rows then counts cells, without a second pass.
    """
    mapped = require_key(grid_panel, "city_name")
    rules = panel_rollup_rules(mapped)
    if unique_rows:
        out = rollup(mapped, keys, rules, count_as="grid_count")
    else:
        out = rollup(mapped, keys, rules, distinct={"grid_count": "grid_id"})
    return out.withColumn("year_month", month_label())


def source_rollup(source: DataFrame, mapping: DataFrame, column: str, how: str) -> DataFrame:
    """One source to city level with the number of contributing rows."""
    joined = source.join(mapping.select("grid_id", "city_id", "city_name", "province"), "grid_id", "left")
    joined = require_key(joined, "city_name")
    keys = ["city_id", "city_name"] + [k for k in ("year", "month") if k in source.columns]
    out = rollup(joined, keys, {column: how, "province": "first"}, count_as="n_grids")
    return out.withColumn("year_month", month_label()) if "month" in keys else out


def annual_summary(df: DataFrame, area: Sequence[str], heat_columns: Sequence[str]) -> DataFrame:
    """Mean canopy, mean log consumption and total hot days per year and area."""
    heat = sum((F.coalesce(F.col(c), F.lit(0)) for c in heat_columns), F.lit(0))
    return df.groupBy("year", *area).agg(
        F.avg("canopy_share").alias("canopy_share"),
        F.avg("ln_elec_kwh").alias("ln_elec_kwh"),
        F.sum(heat).alias("high_temp_days"),
    )


def entity_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct entities per level as (level, n) rows, and the rows.

    All levels in one pass: distinct (level, value) pairs, found with partial sets before the
    shuffle, then counted. Missing values are no entity.
    """
    pairs = [F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("value")) for c in columns]
    counts = df.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.level", "p.value").agg(F.count(F.lit(1)).alias("k"))
    found = F.count("value").alias("n")
    per = counts.groupBy("level").agg(found, F.sum("k").alias("k"))
    names = df.sparkSession.createDataFrame([("rows",), *[(c,) for c in columns]], "level string")
    total = per.agg(F.max("k").alias("n")).select(F.lit("rows").alias("level"), "n")
    known = per.select("level", "n").unionByName(total)
    return names.join(known, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))
