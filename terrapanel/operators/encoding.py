"""Categories to columns: bins, dummies, crosses, imputation, label codes.

Learned pieces are small classes with ``fit`` and ``transform``. What they learn (cut
points, levels, medians) is learned once on the training rows and reused, so splits
always agree on their columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.functions.bins import (
    CANOPY_BREAKS,
    HUMIDITY_BINS,
    PRECIPITATION_BINS_DAILY,
    bin_label,
    quantile_label,
    zero_then_breaks,
)
from terrapanel.functions.scalars import joined_label, month_flag, season_of
from terrapanel.session import checkpointed
from terrapanel.operators.quantiles import exact_quantiles

# Columns of more levels than this are refused unless the caller asks for more.
MOST_LEVELS = 1000


@dataclass
class QuantileBinner:
    """Right-closed quantile bins, by default tertiles at 0.33 and 0.67."""

    column: str
    labels: Sequence[str]
    probs: Sequence[float] = (0.33, 0.67)
    cuts: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame) -> "QuantileBinner":
        found = exact_quantiles(df, [self.column], list(self.probs))[self.column]
        self.cuts = [] if found[0] is None else found
        return self

    @property
    def collapsed(self) -> list[str]:
        """Labels no row can take because two cut points coincide."""
        pairs = zip(self.cuts, self.cuts[1:], self.labels[1:])
        return [name for low, high, name in pairs if low == high]

    def expression(self, default: str | None = "unknown") -> Column:
        if not self.cuts:
            return F.lit(default).cast("string")
        return quantile_label(F.col(self.column), self.cuts, self.labels, default)

    def transform(self, df: DataFrame, output: str, default: str | None = "unknown") -> DataFrame:
        return df.withColumn(output, self.expression(default))


@dataclass
class ZeroInflatedBinner:
    """Zero is its own class; positives split at their median."""

    column: str
    labels: Sequence[str] = ("rural", "urban_low", "urban_high")
    cut: float | None = None

    def fit(self, df: DataFrame) -> "ZeroInflatedBinner":
        positive = df.select(F.when(F.col(self.column) > 0, F.col(self.column)).alias("p"))
        self.cut = exact_quantiles(positive, ["p"], [0.5])["p"][0]
        return self

    def transform(self, df: DataFrame, output: str) -> DataFrame:
        """Adds nothing when the fitted data had no positive value."""
        if self.cut is None:
            return df
        v = F.col(self.column)
        zero, low, high = self.labels
        return df.withColumn(
            output,
            F.when(v == 0, zero)
            .when((v > 0) & (v <= F.lit(self.cut)), low)
            .when(v > F.lit(self.cut), high)
            .otherwise("unknown"),
        )


def category_levels(df: DataFrame, columns: Sequence[str], most: int = MOST_LEVELS) -> dict[str, list[str]]:
    """Sorted levels of several columns in one pass; refuses columns of more than ``most`` exactly counted levels."""
    levels = (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], list(columns), "column", "level").filter(F.col("level").isNotNull()).distinct()
    )
    sizes = {r["column"]: r["count"] for r in levels.groupBy("column").count().collect()}
    wide = [c for c in columns if sizes.get(c, 0) > most]
    if wide:
        raise ValueError(f"too many levels to one-hot encode: {wide}")
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in levels.orderBy("column", "level").collect():  # at most ``most`` a column
        out[r["column"]].append(r["level"])
    return out


@dataclass
class OneHot:
    """0/1 columns ``{prefix}_{level}``; levels come from the fitted rows or are given."""

    columns: Sequence[str]
    prefixes: dict[str, str] = field(default_factory=dict)
    drop_first: bool = False
    drop_source: bool = False
    levels: dict[str, list[str]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "OneHot":
        missing = [c for c in self.columns if c not in self.levels]
        if missing:
            self.levels.update(category_levels(df, missing))
        return self

    def names(self) -> dict[str, tuple[str, str]]:
        out = {}
        for c in self.columns:
            prefix = self.prefixes.get(c, c)
            for level in self.levels[c][1 if self.drop_first else 0 :]:
                out[f"{prefix}_{level}"] = (c, level)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """All dummies in one projection."""
        added = [
            F.when(F.col(c) == F.lit(level), 1).otherwise(0).alias(name) for name, (c, level) in self.names().items()
        ]
        kept = [c for c in df.columns if not (self.drop_source and c in self.columns)]
        return df.select(*kept, *added)


# Category columns whose dummies replace them in the grid panel. Fixed values.
REDUNDANT = (
    "humidity_category", "precipitation_category", "gdp_category", "population_category", "nightlight_category", "canopy_category",
    "season",
)


def drop_redundant(df: DataFrame, columns: Sequence[str] = REDUNDANT) -> DataFrame:
    """Without the category columns that are there."""
    return df.drop(*[c for c in columns if c in df.columns])


def season_features(df: DataFrame) -> DataFrame:
    m = F.col("month")
    return df.withColumns(
        {
            "season": season_of(m),
            "cooling_season": month_flag(m, (6, 7, 8, 9)),
            "heating_season": month_flag(m, (12, 1, 2, 3)),
        }
    )


def temporal_features(df: DataFrame, start_year: int | None = None) -> DataFrame:
    """Summer, winter and peak flags, years since the first year, later-period flag."""
    m, y = F.col("month"), F.col("year")
    if start_year is None:
        start_year = df.agg(F.min("year")).first()[0]
    return df.withColumns(
        {
            "season": season_of(m),
            "is_summer": month_flag(m, (6, 7, 8)),
            "is_winter": month_flag(m, (12, 1, 2)),
            "peak_energy_month": month_flag(m, (1, 2, 7, 8)),
            "years_since_start": y - F.lit(start_year),
            "post_2015": (y >= 2015).cast("int"),
        }
    )


CATEGORY_SOURCES = ("humidity", "precipitation", "gdp", "population", "nightlight", "canopy")

# Which categories are crossed. Fixed values.
CATEGORY_CROSSES = (
    ("canopy", "humidity"),
    ("canopy", "precipitation"),
    ("gdp", "humidity"),
    ("gdp", "precipitation"),
    ("population", "humidity"),
    ("canopy", "gdp"),
    ("canopy", "population"),
    ("canopy", "nightlight"),
)


def category_crosses(df: DataFrame, pairs: Sequence[tuple[str, str]] = CATEGORY_CROSSES) -> DataFrame:
    """``a_x_b`` labels for each pair of category columns that is present."""
    out = {}
    for a, b in pairs:
        left, right = f"{a}_category", f"{b}_category"
        if left in df.columns and right in df.columns:
            out[f"{a}_x_{b}"] = joined_label(left, right)
    return df.withColumns(out) if out else df


# (output, left, right); left and right name columns, dummies included. Fixed values.
PRODUCT_RULES = (
    ("hot_days_x_high_gdp", "extreme_hot_share", "gdp_high_gdp"),
    ("hot_days_x_low_gdp", "extreme_hot_share", "gdp_low_gdp"),
    ("hot_days_x_high_pop", "extreme_hot_share", "population_high_pop"),
    ("hot_days_x_low_pop", "extreme_hot_share", "population_low_pop"),
    ("hot_days_x_urban_high", "extreme_hot_share", "nightlight_urban_high"),
    ("hot_days_x_rural", "extreme_hot_share", "nightlight_rural"),
    ("cold_days_x_high_gdp", "extreme_cold_share", "gdp_high_gdp"),
    ("cold_days_x_low_gdp", "extreme_cold_share", "gdp_low_gdp"),
    ("humid_x_high_gdp", "humidity_RH_high", "gdp_high_gdp"),
    ("dry_x_low_gdp", "humidity_RH_low", "gdp_low_gdp"),
    ("heavy_rain_x_high_pop", "precipitation_rain_days_10_plus", "population_high_pop"),
    ("dry_rain_x_rural", "precipitation_rain_days_0_1mm", "nightlight_rural"),
    ("high_gdp_x_high_pop", "gdp_high_gdp", "population_high_pop"),
    ("low_gdp_x_low_pop", "gdp_low_gdp", "population_low_pop"),
    ("urban_high_x_gdp_high", "nightlight_urban_high", "gdp_high_gdp"),
    ("rural_x_gdp_low", "nightlight_rural", "gdp_low_gdp"),
    ("high_canopy_x_humid", "canopy_high_canopy", "humidity_RH_high"),
    ("high_canopy_x_heavy_rain", "canopy_high_canopy", "precipitation_rain_days_10_plus"),
    ("low_canopy_x_dry", "canopy_low_canopy", "humidity_RH_low"),
    ("low_canopy_x_hot_days", "canopy_low_canopy", "extreme_hot_share"),
)


def product_features(df: DataFrame, rules: Sequence[tuple[str, str, str]] = PRODUCT_RULES) -> DataFrame:
    """Products named by ``rules``, each skipped unless both inputs exist."""
    present = set(df.columns)
    out = {name: F.col(a) * F.col(b) for name, a, b in rules if a in present and b in present}
    return df.withColumns(out) if out else df


#: Groups whose means are sent to every task; more are joined.
BROADCAST_GROUPS = 100_000


def group_mean(df: DataFrame, key: str, value: str, output: str) -> DataFrame:
    """Mean of the row's group on every row.

    Aggregate and join back, not a window: a window would put a whole group in one task. The means
    are stored and counted; up to ``BROADCAST_GROUPS`` go to every task, so the rows need no shuffle.
    """
    means = checkpointed(df.groupBy(key).agg(F.avg(value).alias(output)))
    return df.join(F.broadcast(means) if means.count() <= BROADCAST_GROUPS else means, key, "left")


def ratio_features(df: DataFrame) -> DataFrame:
    """Per-person and per-output consumption, and canopy against its class mean."""
    elec, people, gdp = F.col("elec_kwh"), F.col("population"), F.col("gdp_per_capita")
    out = df.withColumns(
        {
            "elec_per_capita": elec / (people + 1),
            "ln_elec_per_capita": F.log1p(elec / (people + 1)),
            "elec_per_gdp": elec / (gdp * people + 1),
            "ln_elec_per_gdp": F.log1p(elec / (gdp * people + 1)),
        }
    )
    if "population_category" in df.columns:
        out = group_mean(out, "population_category", "canopy_share", "_class_mean")
        out = out.withColumn("canopy_effectiveness", F.col("canopy_share") / (F.col("_class_mean") + 1))
        out = out.drop("_class_mean")
    return out


def weighted_score(rules: Sequence[tuple[Column, int]]) -> Column:
    """Sum of weights of the conditions that hold."""
    return sum((F.when(cond, weight).otherwise(0) for cond, weight in rules), F.lit(0))


def vulnerability_score(humidity: str, precipitation: str, pressure: str) -> Column:
    return weighted_score(
        [(F.col(humidity) == "dry", 3), (F.col(precipitation) == "low", 2), (F.col(pressure) == "high", 1)]
    )


TARGETS = ("elec_kwh", "ln_elec_kwh")


@dataclass
class Imputer:
    """Text to 'missing', numbers to the fitted median, infinities to zero."""

    exempt: Sequence[str] = TARGETS
    medians: dict[str, float] = field(default_factory=dict)

    def _numeric(self, df: DataFrame) -> list[str]:
        kinds = (T.NumericType,)
        return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in self.exempt]

    def fit(self, df: DataFrame) -> "Imputer":
        names = self._numeric(df)
        found = exact_quantiles(df, names, [0.5])
        self.medians = {c: found[c][0] for c in names if found[c][0] is not None}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        types = {f.name: f.dataType for f in df.schema.fields}
        out = []
        for c in df.columns:
            col = F.col(c)
            if c in self.exempt:
                out.append(col)
                continue
            if isinstance(types[c], T.StringType):
                out.append(F.coalesce(col, F.lit("missing")).alias(c))
            elif isinstance(types[c], (T.DoubleType, T.FloatType)):
                v = F.when(~F.isnan(col), col)
                v = F.coalesce(v, F.lit(self.medians.get(c)).cast("double"))
                v = F.when(F.abs(v) != float("inf"), v)
                out.append(F.coalesce(v, F.lit(0.0)).alias(c))
            elif isinstance(types[c], T.NumericType):
                whole = self.medians.get(c, 0.0)
                fill = F.lit(whole).cast("double")
                out.append(F.coalesce(col.cast("double"), fill).alias(c))
            else:
                out.append(col)
        return df.select(*out)


@dataclass
class LabelCodes:
    """Alphabetical integer codes over every split; unseen labels get the next code.

    Columns with more than ``max_levels`` levels are dropped and named in ``dropped``; None keeps all.
    """

    columns: Sequence[str]
    max_levels: int | None = 10
    levels: dict[str, list[str]] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)

    def fit(self, *splits: DataFrame) -> "LabelCodes":
        data = splits[0].select(*self.columns)
        for other in splits[1:]:
            data = data.unionByName(other.select(*self.columns))
        # Only columns of up to max_levels levels are brought back.
        distinct = (
            data.select(*[F.col(c).cast("string").alias(c) for c in self.columns])
            .unpivot([], list(self.columns), "column", "level")
            .filter(F.col("level").isNotNull())
            .distinct()
        )
        sizes = {r["column"]: r["count"] for r in distinct.groupBy("column").count().collect()}
        self.dropped = [c for c in self.columns if self.max_levels is not None and sizes.get(c, 0) > self.max_levels]
        small = [c for c in self.columns if c not in self.dropped]
        self.levels = {c: [] for c in small}
        for r in distinct.filter(F.col("column").isin(*small)).orderBy("column", "level").collect():
            self.levels[r["column"]].append(r["level"])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, levels in self.levels.items():
            codes = F.lit(len(levels))
            if levels:
                table = F.create_map(*[x for i, v in enumerate(levels) for x in (F.lit(v), F.lit(i))])
                codes = F.coalesce(F.try_element_at(table, F.col(c).cast("string")), F.lit(len(levels)))
            out[c] = codes.cast("int")
        return df.withColumns(out).drop(*self.dropped)


# --- the whole feature pipelines --------------------------------------------------

GDP_LABELS = ("low_gdp", "medium_gdp", "high_gdp")
POPULATION_LABELS = ("low_pop", "medium_pop", "high_pop")


@dataclass
class CategoryBinner:
    """All category columns of a panel, with cut points learned in one pass."""

    humidity_bins: Sequence = HUMIDITY_BINS
    precipitation_bins: Sequence = PRECIPITATION_BINS_DAILY
    canopy_breaks: Sequence[tuple[float, str]] = CANOPY_BREAKS
    gdp: QuantileBinner = field(default_factory=lambda: QuantileBinner("gdp_per_capita", GDP_LABELS))
    population: QuantileBinner = field(default_factory=lambda: QuantileBinner("population", POPULATION_LABELS))
    nightlight: ZeroInflatedBinner = field(default_factory=lambda: ZeroInflatedBinner("nightlight"))

    def fit(self, df: DataFrame) -> "CategoryBinner":
        measures = df.select(
            F.col("gdp_per_capita").alias("g"),
            F.col("population").alias("p"),
            F.when(F.col("nightlight") > 0, F.col("nightlight")).alias("n"),
        )
        q = exact_quantiles(measures, ["g", "p", "n"], [0.33, 0.5, 0.67])
        self.gdp.cuts = [q["g"][0], q["g"][2]] if q["g"][0] is not None else []
        self.population.cuts = [q["p"][0], q["p"][2]] if q["p"][0] is not None else []
        self.nightlight.cut = q["n"][1]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumns(
            {
                "humidity_category": bin_label(F.col("rhu"), self.humidity_bins),
                "precipitation_category": bin_label(F.col("prec"), self.precipitation_bins),
                "gdp_category": self.gdp.expression(),
                "population_category": self.population.expression(),
                "canopy_category": zero_then_breaks(
                    F.col("canopy_share"), "no_canopy", self.canopy_breaks, "high_canopy"
                ),
            }
        )
        return self.nightlight.transform(out, "nightlight_category")


def category_columns(df: DataFrame) -> list[str]:
    return [f"{s}_category" for s in CATEGORY_SOURCES if f"{s}_category" in df.columns]


def dummy_prefixes(columns: Sequence[str]) -> dict[str, str]:
    return {c: c.removesuffix("_category") for c in columns}
