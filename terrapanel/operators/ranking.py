"""Feature rankings: consensus over methods, cumulative share, selection.

Ranking tables hold one row per feature and method, so the windows here run over a few
hundred rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.functions.scalars import present
from terrapanel.operators.profile import group_column


def scale_to_best(scores: DataFrame) -> DataFrame:
    """Divide each method's importances by its largest; a method of zeros stays zero."""
    best = F.max("importance").over(W.partitionBy("method"))
    scaled = F.when(best > 0, F.col("importance") / best).otherwise(F.lit(0.0))
    return scores.withColumn("importance", scaled)


def wide_scores(scores: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Methods as columns; a feature a method does not know scores 0."""
    wide = scores.groupBy("feature").pivot("method", list(methods)).agg(F.max("importance"))
    return wide.fillna(0.0, subset=list(methods))


def consensus_ranking(scores: DataFrame, methods: Sequence[str], features: Sequence[str] | None = None) -> DataFrame:
    """Mean, population sd, extremes and number of positive scores over methods."""
    wide = wide_scores(scale_to_best(scores), methods)
    cols = [F.col(m) for m in methods]
    k = F.lit(float(len(methods)))
    mean = sum(cols[1:], cols[0]) / k
    spread = sum(((c - mean) * (c - mean) for c in cols[1:]), (cols[0] - mean) * (cols[0] - mean)) / k
    positive = sum((F.when(c > 0, 1).otherwise(0) for c in cols), F.lit(0))
    lowest = F.least(*cols) if len(cols) > 1 else cols[0]
    highest = F.greatest(*cols) if len(cols) > 1 else cols[0]
    out = wide.select(
        "feature",
        mean.alias("mean_importance"),
        F.sqrt(spread).alias("std_importance"),
        lowest.alias("min_importance"),
        highest.alias("max_importance"),
        positive.alias("methods_count"),
    )
    if features is not None:
        out = out.withColumn("group", group_column(F.col("feature"), features))
    return out


def _by_score(score: str) -> list[Column]:
    return [F.desc(score), F.asc("feature")]


def ranked(df: DataFrame, score: str, output: str = "rank") -> DataFrame:
    """1..n by falling score, ties by name."""
    return df.withColumn(output, F.row_number().over(W.orderBy(*_by_score(score))))


def cumulative_share(df: DataFrame, score: str = "mean_importance") -> DataFrame:
    run = W.orderBy(*_by_score(score)).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("cumulative_importance", F.sum(score).over(run) / F.sum(score).over(W.partitionBy()))


def select_features(
    consensus: DataFrame, threshold: float = 0.95, at_least: int = 20, at_most: int = 60
) -> DataFrame:
    """Features up to the cumulative threshold, their count clamped to the given range."""
    table = ranked(cumulative_share(consensus), "mean_importance")
    within = F.count_if(F.col("cumulative_importance") <= threshold).over(W.partitionBy())
    size = F.when(within < at_least, at_least).when(within > at_most, at_most).otherwise(within)
    return table.withColumn("_size", size).filter(F.col("rank") <= F.col("_size")).drop("_size")


def top_k(df: DataFrame, score: str, k: int, key: str = "feature", largest: bool = True) -> DataFrame:
    kept = df.filter(present(df, score))
    return kept.orderBy(F.desc(score) if largest else F.asc(score), F.asc(key)).limit(k)


def mean_importance(scores: DataFrame) -> DataFrame:
    """Plain mean over models, unscaled."""
    return scores.groupBy("feature").agg(F.avg("importance").alias("importance"))


def keep_selected(df: DataFrame, selected: DataFrame, key: str = "feature") -> DataFrame:
    return df.join(selected.select(key), key, "left_semi")


def with_method(scores: DataFrame, method: str, column: str = "importance") -> DataFrame:
    return scores.select(F.lit(method).alias("method"), "feature", F.coalesce(F.col(column), F.lit(0.0)).alias("importance"))
