"""Feature selection end to end: scores by several methods on training rows, consensus, selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.scalars import complete_rows
from terrapanel.operators import linear as L
from terrapanel.operators import trees as TR
from terrapanel.operators.correlation import target_correlation
from terrapanel.operators.folds import hashed_folds
from terrapanel.operators.neighbours import neighbour_information
from terrapanel.operators.profile import group_column
from terrapanel.operators.ranking import consensus_ranking, select_features, with_method
from terrapanel.operators.sampling import sample_rows
from terrapanel.session import checkpointed

#: Rows that the slow methods learn from; the sample is the same at every run.
SAMPLE_ROWS = 100_000
MODEL_METHODS = ("random_forest", "boosted", "lasso", "mutual_info")
#: Trees of either ensemble, and folds of the penalty search.
ENSEMBLE_TREES = 100
PENALTY_FOLDS = 5


def method_scores(
    train: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], sample: int = SAMPLE_ROWS,
    forest: Mapping | None = None, boosted: Mapping | None = None, alphas: Sequence[float] = L.LASSO_ALPHAS,
) -> DataFrame:
    """Long (method, feature, importance) from a forest, boosted trees, lasso and nearest-neighbour information.

    All learn from the same ``sample`` of complete rows, told apart by ``keys``. The lasso's penalty is chosen
    over folds and its score is the size of a coefficient on standard scores.
    """
    spark = train.sparkSession
    rows = checkpointed(sample_rows(complete_rows(train.select(*keys, *features, target)), list(keys), sample))
    parts = []
    for method, kind, given, size in (
        ("random_forest", "forest", forest, "numTrees"), ("boosted", "boosted", boosted, "maxIter"),
    ):
        model = TR.fit_ensemble(rows, features, target, kind, **{size: ENSEMBLE_TREES, **(given or {})})
        parts.append(with_method(TR.impurity_importance(model, rows, features), method))
    scaled = L.Standardizer(list(features)).fit(rows).transform(rows)
    folds = hashed_folds(scaled, list(keys), PENALTY_FOLDS)
    found = L.grid_search(folds, list(features), target, "fold", "lasso", list(alphas), PENALTY_FOLDS)
    sizes = [(f, abs(float(b))) for f, b in zip(found.model.features, found.model.coefficients)]
    parts.append(with_method(spark.createDataFrame(sizes, "feature string, importance double"), "lasso"))
    parts.append(with_method(neighbour_information(rows, features, target), "mutual_info"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return checkpointed(out)


def select_by_consensus(
    train: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], threshold: float = 0.95, at_least: int = 20,
    at_most: int = 60, level: str = "city", **options,
) -> tuple[DataFrame, DataFrame]:
    """Consensus over the methods with correlation and group beside it, and the features selected from it."""
    scores = method_scores(train, features, target, keys, **options)
    consensus = consensus_ranking(scores, list(MODEL_METHODS), list(features))
    beside = target_correlation(train, list(features), target).select("feature", F.col("abs_correlation").alias("correlation"))
    table = checkpointed(consensus.join(beside, "feature", "left").withColumn("group", group_column(F.col("feature"), list(features))))
    return table, select_features(table, threshold, at_least, at_most)
