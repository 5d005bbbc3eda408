"""Scaling, ridge and lasso, their cross-validated grids, and scoring.

The linear models see the data only through cross-product matrices, one per fold, which
a single pass collects. Every penalty and every fold is then solved from those.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.scalars import complete_rows
from terrapanel.operators.moments import column_means, sum_over_partitions


# --- scaling ----------------------------------------------------------------------


@dataclass
class Standardizer:
    """(x - mean) / sd with the population sd; a constant column is only centred."""

    columns: Sequence[str]
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "Standardizer":
        aggs = [f(c) for c in self.columns for f in (F.avg, F.stddev_pop)]
        row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
        for i, c in enumerate(self.columns):
            self.means[c] = row[2 * i] or 0.0
            self.scales[c] = row[2 * i + 1] or 1.0
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(c) - F.lit(self.means[c])) / F.lit(self.scales[c]) for c in self.columns}
        )


# --- fitted model -------------------------------------------------------------------


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def prediction(self) -> Column:
        out = F.lit(self.intercept)
        for c, b in zip(self.features, self.coefficients):
            if b != 0.0:
                out = out + F.lit(b) * F.col(c).cast("double")
        return out

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.prediction())

    def importance(self, df: DataFrame) -> DataFrame:
        rows = [(f, abs(b)) for f, b in zip(self.features, self.coefficients)]
        return df.sparkSession.createDataFrame(rows, "feature string, importance double")


# --- cross products per fold ----------------------------------------------------------


@dataclass(frozen=True)
class FoldMoments:
    """Per fold: Z'Z for Z = [1, x - shift, y - shift]."""

    features: tuple[str, ...]
    shift: np.ndarray
    folds: np.ndarray  # (k, p, p)


def fold_moments(df: DataFrame, features: Sequence[str], target: str, fold: str | None = None, k: int = 1) -> FoldMoments:
    """Cross products of each fold in one pass; rows with a missing value are left out."""
    cols = [*features, target]
    ready = complete_rows(df, cols)
    shift = column_means(ready, cols)
    p = len(cols) + 1

    def batch(m: np.ndarray) -> np.ndarray:
        which = m[:, 0].astype(int)
        z = np.column_stack([np.ones(len(m)), m[:, 1:] - shift])
        out = np.zeros((k, p, p))
        for f in range(k):
            part = z[which == f] if k > 1 else z
            out[f] = part.T @ part
        return out

    tagged = ready.withColumn("_fold", F.col(fold) if fold else F.lit(0))
    sums = sum_over_partitions(tagged, ["_fold", *cols], batch, k * p * p)
    return FoldMoments(tuple(features), shift, sums.reshape(k, p, p))


def _centred(g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float]:
    """n, means and centred X'X, X'y, y'y from a cross-product matrix."""
    n = g[0, 0]
    m = g[0, 1:] / n
    c = g[1:, 1:] - n * np.outer(m, m)
    return n, m, c[:-1, :-1], c[:-1, -1], c[-1, -1]


def _ridge(xx: np.ndarray, xy: np.ndarray, n: float, alpha: float) -> np.ndarray:
    """Minimises ||y - Xb||^2 + alpha ||b||^2."""
    return np.linalg.lstsq(xx + alpha * np.eye(len(xx)), xy, rcond=None)[0]


def _lasso(xx: np.ndarray, xy: np.ndarray, n: float, alpha: float) -> np.ndarray:
    """Minimises ||y - Xb||^2 / 2n + alpha ||b||_1, one coordinate at a time."""
    b = np.zeros(len(xx))
    scale = np.diag(xx)
    for _ in range(10_000):
        moved = 0.0
        for j in np.flatnonzero(scale > 0):
            partial = xy[j] - xx[j] @ b + scale[j] * b[j]
            new = np.sign(partial) * max(abs(partial) - n * alpha, 0.0) / scale[j]
            moved = max(moved, abs(new - b[j]) * np.sqrt(scale[j] / n))
            b[j] = new
        if moved < 1e-10:
            return b
    raise ArithmeticError("the lasso did not settle in 10,000 rounds")


_SOLVERS = {"ridge": _ridge, "lasso": _lasso}


def solve(moments: FoldMoments, kind: str, alpha: float, without: int | None = None) -> LinearModel:
    g = moments.folds.sum(axis=0) - (moments.folds[without] if without is not None else 0.0)
    n, m, xx, xy, _ = _centred(g)
    b = _SOLVERS[kind](xx, xy, n, alpha)
    means = m + moments.shift
    return LinearModel(moments.features, tuple(float(v) for v in b), float(means[-1] - b @ means[:-1]))


def _squared_error(g: np.ndarray, model: LinearModel, shift: np.ndarray) -> float:
    """Sum of squared errors of ``model`` on rows summarised by ``g``."""
    b = np.asarray(model.coefficients)
    const = model.intercept + b @ shift[:-1] - shift[-1]
    v = np.concatenate([[-const], -b, [1.0]])
    return float(v @ g @ v)


@dataclass(frozen=True)
class GridResult:
    kind: str
    best_alpha: float
    cv_mse: dict[float, float]
    model: LinearModel

    @property
    def cv_rmse(self) -> float:
        return float(np.sqrt(max(self.cv_mse[self.best_alpha], 0.0)))


def grid_search(
    df: DataFrame, features: Sequence[str], target: str, fold: str, kind: str, alphas: Sequence[float], k: int = 5,
    moments: FoldMoments | None = None,
) -> GridResult:
    """k-fold search over penalties, refitted on all rows; mean of per-fold errors decides."""
    mo = moments or fold_moments(df, features, target, fold, k)
    used = [f for f in range(len(mo.folds)) if mo.folds[f][0, 0] > 0]
    cv = {}
    for alpha in alphas:
        errors = []
        for f in used:
            model = solve(mo, kind, alpha, without=f)
            errors.append(_squared_error(mo.folds[f], model, mo.shift) / mo.folds[f][0, 0])
        cv[alpha] = float(np.mean(errors))
    best = min(cv, key=lambda a: (cv[a], a))
    return GridResult(kind, best, cv, solve(mo, kind, best))


def fit_linear(df: DataFrame, features: Sequence[str], target: str, kind: str = "ridge", alpha: float = 1.0) -> LinearModel:
    return solve(fold_moments(df, features, target), kind, alpha)


# The penalties searched.
RIDGE_ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)
LASSO_ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0)


# --- scoring ----------------------------------------------------------------------------


def regression_metrics(df: DataFrame, target: str, prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """R2, RMSE and MAE in one aggregation, per ``by`` group where given."""
    y = F.col(target).cast("double")
    e = y - F.col(prediction)
    sse, n = F.sum(e * e), F.count(e)
    return df.groupBy(*by).agg(
        n.alias("n"),
        (F.lit(1.0) - F.try_divide(sse, F.var_pop(F.when(e.isNotNull(), y)) * n)).alias("r2"),
        F.sqrt(F.try_divide(sse, n)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
    )


def model_comparison(scored: dict[str, DataFrame], target: str, cv_rmse: dict[str, float]) -> DataFrame:
    """One row per model from rows tagged train/validation, best validation R2 first."""
    table = None
    for name, df in scored.items():
        m = regression_metrics(df, target, by=["split"])
        wide = m.agg(
            *[
                F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}")
                for s in ("train", "validation")
                for c in ("r2", "rmse", "mae")
            ]
        ).select(F.lit(name).alias("model"), "*", F.lit(cv_rmse.get(name)).cast("double").alias("cv_rmse"))
        table = wide if table is None else table.unionByName(wide)
    gap = F.col("train_r2") - F.col("validation_r2")
    return table.withColumn("overfitting", gap).orderBy(F.desc("validation_r2"), "model")
