"""Profiles of a panel: missing values, ranges, coverage, rule violations, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.scalars import columns_matching, columns_of, nan_to_null, row_sum
from terrapanel.operators.quantiles import beside, exact_quantiles, exact_quantiles_by


def unpivot_columns(
    df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (), name: str = "variable", value: str = "value"
) -> DataFrame:
    """Wide to long with missing values left out; all measures become doubles."""
    cast = nan_to_null(df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]))
    return cast.unpivot(list(ids), list(columns), name, value).filter(F.col(value).isNotNull())


def _per_column(df: DataFrame, columns: Sequence[str], stats: dict[str, callable]) -> DataFrame:
    """One aggregation over many columns, returned as one row per column."""
    structs = [
        F.struct(F.lit(c).alias("variable"), *[f(F.col(c)).alias(n) for n, f in stats.items()]) for c in columns
    ]
    return nan_to_null(df.select(*columns)).agg(F.array(*structs).alias("r")).select(F.inline("r"))


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percentage of each column that has any null."""
    columns = list(columns or df.columns)
    profile = _per_column(
        df,
        columns,
        {
            "null_count": lambda c: F.count_if(c.isNull()),
            "null_pct": lambda c: F.count_if(c.isNull()) * 100.0 / F.count(F.lit(1)),
        },
    )
    return profile.filter(F.col("null_count") > 0)


def variable_summary(df: DataFrame, column: str, entity: str = "grid_id") -> DataFrame:
    """Row count, distinct entities and months, and moments of one variable."""
    value = F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(entity).alias("entities"),
        F.count_distinct("year", "month").alias("months"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def monthly_profile(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("month").agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))


def _with_quantiles(df: DataFrame, stats: DataFrame, columns: Sequence[str], named: dict[str, float]) -> DataFrame:
    """Attach exact quantiles, computed apart, to a one-row-per-column table."""
    found = exact_quantiles(df, columns, list(named.values()))
    out = stats
    pairs: dict[str, Column] = {}
    for i, name in enumerate(named):
        table = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(found[c][i]).cast("double"))])
        pairs[name] = table[F.col("variable")]
    return out.withColumns(pairs)


def range_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min, max, mean, sd and quartiles of each variable."""
    columns = [c for c in columns if c in df.columns]
    stats = _per_column(
        df,
        columns,
        {
            "min": lambda c: F.min(c.cast("double")),
            "max": lambda c: F.max(c.cast("double")),
            "mean": F.avg,
            "std": F.stddev_samp,
        },
    )
    return _with_quantiles(df, stats, columns, {"q25": 0.25, "q75": 0.75})


def summary_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Descriptive table of numeric columns: n, extremes, mean, median, quartiles, sd."""
    columns = list(columns or columns_of(df))
    stats = _per_column(
        df,
        columns,
        {
            "n": F.count,
            "max": lambda c: F.max(c.cast("double")),
            "min": lambda c: F.min(c.cast("double")),
            "mean": F.avg,
            "sd": F.stddev_samp,
        },
    )
    return _with_quantiles(df, stats, columns, {"median": 0.5, "p25": 0.25, "p75": 0.75})


def time_coverage(df: DataFrame) -> DataFrame:
    """First and last year, the months seen and the number of distinct months."""
    distinct = df.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))
    return distinct.agg(
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.array_join(F.array_sort(F.collect_set("month")), ",").alias("months"),
        F.count(F.lit(1)).alias("year_months"),
        F.sum("n").alias("rows"),
    )


def rows_per(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).dropDuplicates()


def entity_coverage(df: DataFrame, entity: str = "grid_id", others: Sequence[str] = ()) -> DataFrame:
    """Distinct entities and the mean and sd of rows per entity."""
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    base = per.agg(
        F.count(F.col(entity)).alias(f"unique_{entity}"),
        F.avg("n").alias("rows_mean"),
        F.stddev_samp("n").alias("rows_std"),
    )
    if not others:
        return base
    more = df.agg(*[F.count_distinct(c).alias(f"unique_{c}") for c in others])
    # two single rows, laid over each other
    both = base.unionByName(more, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def group_size_range(df: DataFrame, key: str) -> DataFrame:
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.count(F.lit(1)).alias("groups"))


def rule_violations(df: DataFrame, low_days: float = 20, high_days: float = 40) -> DataFrame:
    """Counts of rows that break each plausibility rule."""
    rules: dict[str, Column] = {}
    if "elec_kwh" in df.columns:
        rules["negative_elec"] = F.col("elec_kwh") < 0
        if "gdp_per_capita" in df.columns:
            q75 = exact_quantiles(df, ["gdp_per_capita"], [0.75])["gdp_per_capita"][0]
            rules["zero_elec_high_gdp"] = (F.col("elec_kwh") == 0) & (F.col("gdp_per_capita") > F.lit(q75))
    days = columns_matching(df, contains=("days_in_bin_",), without=("_x_canopy",))
    if days:
        total = row_sum(days)
        rules["unusual_bin_sum"] = (total < low_days) | (total > high_days)
    structs = [F.struct(F.lit(n).alias("rule"), F.count_if(c).alias("violations")) for n, c in rules.items()]
    read = [c for c in ("elec_kwh", "gdp_per_capita") if c in df.columns]
    return nan_to_null(df.select(*read, *days)).agg(F.array(*structs).alias("r")).select(F.inline("r"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, level, n) for categorical columns; one shuffle for all of them."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "variable", "level")
    return long.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))


def histogram(value: Column, low: float, high: float, bins: int) -> Column:
    """1-based bin of equal width; the top edge belongs to the last bin."""
    width = (high - low) / bins
    index = F.floor((value - F.lit(low)) / F.lit(width)).cast("int") + 1
    inside = (value >= F.lit(low)) & (value <= F.lit(high))
    return F.when(inside, F.least(index, F.lit(bins)))


def histogram_counts(df: DataFrame, value: Column, bins: int = 50, name: str = "value") -> DataFrame:
    """Counts per bin between the observed minimum and maximum."""
    data = nan_to_null(df.select(value.cast("double").alias(name))).filter(F.col(name).isNotNull())
    low, high = data.agg(F.min(name), F.max(name)).first()
    if low is None or low == high:
        return data.groupBy(F.lit(1).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return data.groupBy(histogram(F.col(name), low, high, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_statistics(df: DataFrame, columns: Sequence[str], by: str = "year") -> DataFrame:
    """Quartiles and whiskers at 1.5 IQR, the whisker being the last value inside.

    One row a group holds the fences of all columns, so the table itself is neither unpivoted nor shuffled whole.
    """
    q = exact_quantiles_by(df, [by], columns, [0.25, 0.5, 0.75])
    named = q.select(F.col(by), *[F.col(f"`{c}`").alias(f"_q{i}") for i, c in enumerate(columns)])
    values = nan_to_null(df.select(by, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)]))
    parts, aggs = [], []
    for i, c in enumerate(columns):
        v, three = F.col(f"_v{i}"), F.col(f"_q{i}")
        reach = 1.5 * (three[2] - three[0])
        low, high = three[0] - reach, three[2] + reach
        aggs += [
            F.min(F.when(v >= low, v)).alias(f"_l{i}"), F.max(F.when(v <= high, v)).alias(f"_h{i}"),
            F.count_if((v < low) | (v > high)).alias(f"_o{i}"),
        ]
        parts.append(F.struct(
            F.lit(c).alias("variable"), three[0].alias("q25"), three[1].alias("median"), three[2].alias("q75"),
            F.col(f"_l{i}").alias("whisker_low"), F.col(f"_h{i}").alias("whisker_high"), F.col(f"_o{i}").alias("outliers"),
        ))
    found = beside(values, named, [by]).groupBy(by).agg(*aggs)
    rows = beside(found, named, [by]).select(by, F.inline(F.array(*parts)))
    return rows.filter(F.col("q25").isNotNull())


def mean_by_family(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Average of each column of a family, one row per column."""
    return _per_column(df, columns, {"mean": F.avg})


def informative_numeric(df: DataFrame) -> list[str]:
    """Numeric columns whose sd is neither missing nor zero."""
    names = columns_of(df)
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in names]).first()
    return [c for c in names if row[c] is not None and row[c] > 0]


def replace_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values beyond 1.5 IQR of the quartiles become the median."""
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    out = {}
    for c in columns:
        q1, mid, q3 = q[c]
        if q1 is None:
            continue
        reach = 1.5 * (q3 - q1)
        v = F.col(c)
        out[c] = F.when((v < F.lit(q1 - reach)) | (v > F.lit(q3 + reach)), F.lit(mid)).otherwise(v.cast("double"))
    return df.withColumns(out)


def rmse(residual: Column) -> Column:
    return F.sqrt(F.avg(residual * residual))


# Members by name, and parts of names with what excludes them.
GROUP_MEMBERS = {
    "grid": {
        "target": ["elec_kwh", "ln_elec_kwh"],
        "spatial": ["grid_row", "grid_col", "x_albers", "y_albers", "lon", "lat", "grid_id"],
        "temporal": ["year", "month", "year_month"],
        "location": ["city_id", "city_name", "province"],
        "climate_raw": ["prec", "pres", "rhu", "wind"],
        "socioeconomic_raw": ["gdp_per_capita", "population", "nightlight"],
    },
    "city": {
        "target": ["elec_kwh", "ln_elec_kwh"],
        "spatial": ["lon", "lat", "city_id"],
        "temporal": ["year", "month", "year_month"],
        "location": ["city_name", "province"],
        "climate_raw": ["prec", "pres", "rhu", "wind"],
        "socioeconomic_raw": ["gdp_per_capita", "population", "nightlight"],
    },
}
# Group: parts of which one must be in the name, parts that must all be, parts that must not be.
GROUP_PARTS = {
    "temperature_interactions": (["days_in_bin_"], ["_x_canopy"], []),
    "temperature_bins": (["days_in_bin_"], [], ["_x_canopy"]),
    "temperature_derived": (["extreme_", "moderate_", "entropy", "total_days"], [], []),
    "climate_categorical": (["humidity_", "precipitation_"], [], []),
    "socioeconomic_categorical": (["gdp_", "population_", "nightlight_"], [], []),
    "canopy": (["canopy"], [], ["_x_", "days_in_bin"]),
    "seasonal": (["season_", "heating_", "cooling_"], [], []),
    "interactions": (["_x_"], [], ["days_in_bin"]),
}
# Groups of the structure report, which differ from the selector's.
STRUCTURE_MEMBERS = {
    "climate_variables": ["prec", "pres", "rhu", "wind"],
    "socioeconomic_variables": ["gdp_per_capita", "population", "nightlight"],
    "spatial_variables": ["grid_row", "grid_col", "x_albers", "y_albers", "lon", "lat", "grid_id", "city_id", "city_name", "province"],
    "temporal_variables": ["year", "month", "year_month"],
    "target_variables": ["elec_kwh", "ln_elec_kwh"],
}
STRUCTURE_PARTS = {
    "temperature_bins": (["days_in_bin_"], [], ["_x_canopy"]),
    "temperature_interactions": (["days_in_bin_"], ["_x_canopy"], []),
    "canopy_variables": (["canopy"], [], ["x_canopy"]),
}


def _has_parts(name: str, rule: tuple[list[str], list[str], list[str]]) -> bool:
    some, every, none = rule
    return any(p in name for p in some) and all(p in name for p in every) and not any(p in name for p in none)


def column_group(name: str, level: str = "city") -> str:
    """Group of a column: by its whole name, else the first whose parts it has."""
    for group, members in GROUP_MEMBERS[level].items():
        if name in members:
            return group
    return next((g for g, rule in GROUP_PARTS.items() if _has_parts(name, rule)), "other")


def structure_report(df: DataFrame, level: str = "city") -> dict[str, list[str]]:
    """Columns by group, from names alone."""
    out: dict[str, list[str]] = {}
    for c in df.columns:
        out.setdefault(column_group(c, level), []).append(c)
    return out


def structure_groups(df: DataFrame) -> dict[str, list[str]]:
    """Columns by the structure report's own groups; a column may be in none."""
    out = {g: [c for c in df.columns if _has_parts(c, rule)] for g, rule in STRUCTURE_PARTS.items()}
    return out | {g: [c for c in df.columns if c in members] for g, members in STRUCTURE_MEMBERS.items()}


def dataset_structure(df: DataFrame) -> DataFrame:
    """(column_group, n_columns, total_rows, total_columns) of a table."""
    lines = [F.struct(F.lit(g).alias("column_group"), F.lit(len(c)).cast("bigint").alias("n_columns")) for g, c in structure_groups(df).items()]
    rows = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return rows.select(F.inline(F.array(*lines)), "total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_columns"))


def group_column(column: Column, names: Sequence[str]) -> Column:
    """Group of a feature name held in a column; the lookup is a literal map."""
    lookup = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(column_group(n)))])
    return F.coalesce(lookup[column], F.lit("other"))


def shared_columns(train: DataFrame, other: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Columns in both, only in the first, only in the second; sorted."""
    a, b = set(train.columns), set(other.columns)
    return sorted(a & b), sorted(a - b), sorted(b - a)


# Never used as predictors. Fixed values.
NOT_PREDICTORS = {
    "grid": ("elec_kwh", "ln_elec_kwh", "grid_id", "city_id", "city_name", "province", "year_month",
             "x_albers", "y_albers", "grid_row", "grid_col"),
    "city": ("elec_kwh", "ln_elec_kwh", "city_id", "city_name", "province", "year_month", "grid_count"),
}


def predictor_columns(df: DataFrame, level: str = "grid") -> list[str]:
    return [c for c in df.columns if c not in NOT_PREDICTORS[level]]
