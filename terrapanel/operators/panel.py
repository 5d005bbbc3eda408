"""Panel integration: validity rules, joins to dimensions, fills, products, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.scalars import columns_matching, month_label, products_with

# Which raw values count as measured, by source. Bounds differ on purpose.
# Must equal the established rules.
VALIDITY = {
    "elec_kwh": "> 0",
    "canopy_share": ">= 0",
    "nightlight": ">= 0",
    "population": ">= 0",
    "gdp_per_capita": "> 0",
}
NOT_NULL_ONLY = ("prec", "pres", "rhu", "wind")

# Sources whose missing months become zero after the join. ``INTENDED_FILL`` also covers
# the two that a name mismatch leaves out of the effective rule.
EFFECTIVE_FILL = ("nightlight", "population", "prec", "pres", "rhu", "wind")
INTENDED_FILL = EFFECTIVE_FILL + ("canopy_share", "gdp_per_capita")

# The established years of each split.
DEFAULT_SPLIT = {"train": range(2012, 2018), "validation": (2018,), "test": (2019,)}


def keep_valid(df: DataFrame, column: str, nodata: float | None = None) -> DataFrame:
    """Drop rows whose measure is missing, nodata or outside its validity rule."""
    value = F.col(column)
    cond = value.isNotNull()
    if dict(df.dtypes)[column] in ("double", "float"):
        cond = cond & ~F.isnan(value)
    if nodata is not None:
        cond = cond & (value != F.lit(nodata))
    if column in VALIDITY:
        op, bound = VALIDITY[column].split()
        cond = cond & ((value > F.lit(float(bound))) if op == ">" else (value >= F.lit(float(bound))))
    return df.filter(cond)


def replicate_annual(df: DataFrame, month: str = "month") -> DataFrame:
    """One row per year becomes one row per month 1..12."""
    return df.withColumn(month, F.explode(F.sequence(F.lit(1), F.lit(12))))


def left_join_sources(
    base: DataFrame,
    sources: dict[str, DataFrame | None],
    keys: dict[str, Sequence[str]],
) -> tuple[DataFrame, list[str]]:
    """Left-join each present source on its own keys; return also the names skipped.

    No broadcast is forced: the runtime picks one only after it has measured a side.
    Base and sources stored in the same buckets of the entity (``sources.layout``) join
    without a shuffle. Other sources that share the key list of the base shuffle once and
    stay co-partitioned, so give monthly sources first.
    """
    out, skipped = base, []
    for name, src in sources.items():
        if src is None:
            skipped.append(name)
            continue
        on = list(keys[name])
        value_cols = [c for c in src.columns if c not in out.columns]
        out = out.join(src.select(*on, *value_cols), on, "left")
    return out, skipped


def fill_constants(df: DataFrame, columns: Sequence[str] = EFFECTIVE_FILL, value: float = 0.0) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.fillna(value, subset=present) if present else df


def add_canopy_products(df: DataFrame, factor: str = "canopy_share") -> DataFrame:
    """``days_in_* x canopy`` for every day-count column, in one projection."""
    if factor not in df.columns:
        return df
    return df.withColumns(products_with(day_columns(df), factor, "_x_canopy"))


def day_columns(df: DataFrame) -> list[str]:
    return columns_matching(df, prefix="days_in_", without=("_x_canopy",))


def integrate_panel(
    base: DataFrame,
    sources: dict[str, DataFrame | None],
    keys: dict[str, Sequence[str]],
    fill: Sequence[str] = EFFECTIVE_FILL,
) -> DataFrame:
    """The full (grid, year, month) panel: joins, fills, products and month label."""
    panel, _ = left_join_sources(base, sources, keys)
    panel = add_canopy_products(fill_constants(panel, fill))
    return panel.withColumn("year_month", month_label())


def split_column(year: Column, years: dict[str, Sequence[int]] | None = None) -> Column:
    """Name of the split holding ``year``; NULL outside all of them."""
    out = None
    for name, members in (years or DEFAULT_SPLIT).items():
        cond = year.isin(*members)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def temporal_split(df: DataFrame, years: dict[str, Sequence[int]] | None = None) -> DataFrame:
    return df.withColumn("split", split_column(F.col("year"), years))


def require_key(df: DataFrame, key: str = "city_name") -> DataFrame:
    return df.filter(F.col(key).isNotNull())


def derive_entity_id(df: DataFrame, name: str = "city_name", region: str = "province") -> DataFrame:
    """``name_region`` where no ``city_id`` exists yet."""
    if "city_id" in df.columns:
        return df
    return df.withColumn("city_id", F.concat(F.col(name), F.lit("_"), F.col(region)))


def drop_if_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
