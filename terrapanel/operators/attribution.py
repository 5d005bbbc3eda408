"""Attribution rows and their rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.operators.linear import LinearModel
from terrapanel.operators.ranking import ranked
from terrapanel.operators.sampling import extreme_rows, median_neighbours


def linear_attributions(
    model: LinearModel, df: DataFrame, keys: Sequence[str], background: DataFrame | None = None
) -> DataFrame:
    """coefficient x (value - background mean) per feature, as columns."""
    means = (background if background is not None else df).agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(model.features)]
    ).first()
    cols = [
        (F.lit(b) * (F.col(c).cast("double") - F.lit(means[i]))).alias(c)
        for i, (c, b) in enumerate(zip(model.features, model.coefficients))
    ]
    base = model.intercept + sum(b * (means[i] or 0.0) for i, b in enumerate(model.coefficients))
    return df.select(*keys, *cols, F.lit(float(base)).alias("base_value"))


def mean_absolute(attributions: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, shap_importance, mean_effect, rank)."""
    structs = [
        F.struct(
            F.lit(c).alias("feature"),
            F.avg(F.abs(F.col(c))).alias("shap_importance"),
            F.avg(F.col(c)).alias("mean_effect"),
        )
        for c in features
    ]
    return ranked(attributions.agg(F.array(*structs).alias("r")).select(F.inline("r")), "shap_importance")


# Categories of features by name fragment; a feature may be in several. Fixed values.
CATEGORIES = {
    "Tree_Canopy": ("canopy",),
    "Temperature": ("temp", "days_in_bin"),
    "Socioeconomic": ("gdp", "population", "nightlight"),
    "Climate": ("prec", "humidity", "rhu", "wind", "pres"),
    "Spatial_Temporal": ("lat", "lon", "year", "month"),
}


def category_rollup(
    attributions: DataFrame, features: Sequence[str], categories: dict[str, Sequence[str]] = CATEGORIES
) -> DataFrame:
    """Mean absolute and mean signed attribution over all rows and features of a category."""
    structs = []
    for name, parts in categories.items():
        members = [f for f in features if any(p in f.lower() for p in parts)]
        if not members:
            continue
        k = F.lit(float(len(members)))
        absolute = sum((F.abs(F.col(c)) for c in members[1:]), F.abs(F.col(members[0])))
        signed = sum((F.col(c) for c in members[1:]), F.col(members[0]))
        structs.append(
            F.struct(
                F.lit(name).alias("category"),
                (F.avg(absolute) / k).alias("importance"),
                (F.avg(signed) / k).alias("effect"),
                F.lit(len(members)).alias("n_features"),
            )
        )
    return attributions.agg(F.array(*structs).alias("r")).select(F.inline("r"))


def savings_summary(attributions: DataFrame, features: Sequence[str]) -> DataFrame:
    """Of the negative attributions only: mean log reduction, percentage, counts."""
    structs = []
    for c in features:
        v = F.col(c)
        saving = -F.avg(F.when(v < 0, v))
        structs.append(
            F.struct(
                F.lit(c).alias("feature"),
                saving.alias("avg_log_reduction"),
                (F.expm1(saving) * 100).alias("approx_pct_savings"),
                F.count_if(v < 0).alias("samples_with_savings"),
                F.count(v).alias("total_samples"),
            )
        )
    rows = attributions.agg(F.array(*structs).alias("r")).select(F.inline("r"))
    return rows.filter(F.col("samples_with_savings") > 0)


def interesting_cases(df: DataFrame, target: str, key: str, k: int = 5) -> DataFrame:
    """The k largest, k smallest and k middle rows by ``target``."""
    parts = {
        "high_consumption": extreme_rows(df, target, key, k, largest=True),
        "low_consumption": extreme_rows(df, target, key, k, largest=False),
        "median_consumption": median_neighbours(df, target, key, k),
    }
    out = None
    for name, part in parts.items():
        tagged = part.withColumn("case", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def local_explanations(
    attributions: DataFrame, features: Sequence[str], ids: Sequence[str], top: int = 15
) -> DataFrame:
    """The ``top`` features by absolute attribution for each chosen row."""
    long = attributions.select(*ids, *features).unpivot(list(ids), list(features), "feature", "attribution")
    order = W.partitionBy(*ids).orderBy(F.desc(F.abs("attribution")), "feature")
    return long.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def local_accuracy(attributions: DataFrame, features: Sequence[str], prediction: Column) -> Column:
    """Difference between a prediction and the base value plus all attributions."""
    return prediction - F.col("base_value") - sum((F.col(c) for c in features[1:]), F.col(features[0]))
