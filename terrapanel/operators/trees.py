"""Tree ensembles: fitting, fold-wise search, importances and exact tree attributions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.scalars import complete_rows
from terrapanel.session import checkpointed, ensure_checkpoint_dir


def ensemble(kind: str, target: str, seed: int = 42, **params):
    """'forest' or 'boosted'; other arguments go to the Spark estimator."""
    common = {"featuresCol": "features", "labelCol": target, "seed": seed}
    if kind == "forest":
        return RandomForestRegressor(**common, **params)
    if kind == "boosted":
        return GBTRegressor(**common, **params)
    raise ValueError(kind)


def pipeline(kind: str, features: Sequence[str], target: str, **params) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, ensemble(kind, target, **params)])


def fit_ensemble(df: DataFrame, features: Sequence[str], target: str, kind: str = "forest", **params) -> PipelineModel:
    ready = complete_rows(df.select(*features, target))
    return pipeline(kind, features, target, **params).fit(ready)


def search_ensemble(
    df: DataFrame, features: Sequence[str], target: str, kind: str, grid: dict[str, Sequence], fold: str, k: int = 5,
    parallelism: int = 4, **params,
):
    """Grid search over given folds; returns the refitted model and each setting's CV RMSE."""
    flow = pipeline(kind, features, target, **params)
    estimator = flow.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    cv = CrossValidator(
        estimator=flow,
        estimatorParamMaps=builder.build(),
        evaluator=RegressionEvaluator(labelCol=target, metricName="rmse"),
        numFolds=k,
        foldCol=fold,
        parallelism=parallelism,
    )
    fitted = cv.fit(complete_rows(df.select(*features, target, fold)))
    names = [{p.name: v for p, v in m.items()} for m in cv.getEstimatorParamMaps()]
    return fitted.bestModel, list(zip(names, fitted.avgMetrics))


# The settings searched. Depths beyond 30 are not offered by the estimators, so 30 stands for no limit.
FOREST_GRID = {"numTrees": [100, 200, 300], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2, 4]}
BOOSTED_GRID = {"maxIter": [100, 200, 300], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.1, 0.2], "subsamplingRate": [0.8, 0.9, 1.0]}
_SIZES = {"forest": "numTrees", "boosted": "maxIter"}


def search_by_prefixes(
    df: DataFrame, features: Sequence[str], target: str, kind: str, grid: dict[str, Sequence], fold: str, k: int = 5,
    parallelism: int = 4, **params,
) -> tuple[PipelineModel, list[tuple[dict, float]]]:
    """Grid search that fits each ensemble once, at its largest size, and scores its beginnings as the smaller ones.

    The first trees of an ensemble are the smaller ensemble, in a forest by its seeds and in boosting by
    construction, so a fold needs one fit for each setting of the other parameters and one pass that scores
    all sizes. Boosting grows one tree after the other, each level a short job, so ``parallelism`` fits run side
    by side and the rows they pass over are dealt evenly, to as many partitions as tasks can run at once.
    Returns the refitted best model and each setting's CV RMSE, mean of squared errors over folds.
    """
    name = _SIZES[kind]
    sizes = sorted(grid[name])
    others = [{}]
    for p, values in grid.items():
        if p != name:
            others = [{**o, p: v} for o in others for v in values]
    spark = df.sparkSession
    ready = checkpointed(complete_rows(df.select(*features, target, fold)).repartition(spark.sparkContext.defaultParallelism))

    def errors_of(task: tuple[dict, int]) -> np.ndarray:
        setting, f = task
        train, rest = ready.filter(F.col(fold) != f), ready.filter(F.col(fold) == f)
        model = pipeline(kind, features, target, **{**params, **setting, name: sizes[-1]}).fit(train)
        return _prefix_errors(model, rest, features, target, kind, sizes)

    with ThreadPool(parallelism) as pool:
        found = pool.map(inheritable_thread_target(spark)(errors_of), [(o, f) for o in others for f in range(k)], chunksize=1)
    results = []
    for setting, errors in zip(others, np.reshape(found, (len(others), k, len(sizes)))):
        results += [({**setting, name: n}, float(np.sqrt(e))) for n, e in zip(sizes, errors.mean(0))]
    best = min(results, key=lambda r: r[1])[0]
    return pipeline(kind, features, target, **{**params, **best}).fit(ready), results


def _prefix_errors(model: PipelineModel, df: DataFrame, features: Sequence[str], target: str, kind: str, sizes: Sequence[int]) -> np.ndarray:
    """Mean squared error of the ensemble's first trees, for each size, in one pass."""
    found = model_nodes(model, df)
    roots, feature, cut, left, right, _, value = found.plain()
    if kind == "forest":  # undo the average over all trees
        value = value * len(roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(sizes)), 0
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]])
            y = batch.columns[-1].to_numpy(zero_copy_only=False)
            run_sum = np.zeros(len(x))
            for t, root in enumerate(roots.tolist(), 1):
                at = np.full(len(x), root)
                while (inner := feature[at] >= 0).any():
                    rows, here = np.flatnonzero(inner), at[inner]
                    at[rows] = np.where(x[rows, feature[here]] <= cut[here], left[here], right[here])
                run_sum += value[at]
                for i, size in enumerate(sizes):
                    if t == min(size, len(roots)):
                        total[i] += ((y - run_sum / (t if kind == "forest" else 1)) ** 2).sum()
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sizes)), pa.int32()), pa.array(total), pa.array([n] * len(sizes), pa.int64())], names=["i", "e", "n"])

    data = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("y"))
    rows = data.mapInArrow(run, "i int, e double, n long").groupBy("i").agg((F.sum("e") / F.sum("n")).alias("e")).collect()
    out = np.full(len(sizes), np.nan)
    for r in rows:
        out[r["i"]] = r["e"]
    return out


def impurity_importance(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


# --- attributions ---------------------------------------------------------------------


@dataclass(frozen=True)
class Leaf:
    """A leaf as a box: per used feature an interval and the share of rows kept by it."""

    value: float
    features: np.ndarray
    low: np.ndarray  # exclusive
    high: np.ndarray  # inclusive
    ratio: np.ndarray


def model_leaves(model: PipelineModel, df: DataFrame) -> list[Leaf]:
    """Leaves of every tree, weighted."""
    return model_leaves_of(model_nodes(model, df))


def model_leaves_of(trees: Trees) -> list[Leaf]:
    out: list[Leaf] = []
    for root in trees.roots.tolist():
        stack = [(root, {})]
        while stack:
            i, box = stack.pop()
            j = int(trees.feature[i])
            if j < 0:
                f = sorted(box)
                low, high, ratio = (np.array([box[k][m] for k in f]) for m in range(3))
                out.append(Leaf(float(trees.value[i]), np.array(f, dtype=int), low, high, ratio))
                continue
            low, high, ratio = box.get(j, (-np.inf, np.inf, 1.0))
            cut = trees.cut[i]
            for child, bounds in ((trees.left[i], (low, min(high, cut))), (trees.right[i], (max(low, cut), high))):
                stack.append((int(child), {**box, j: (*bounds, ratio * trees.share[child])}))
    return out


def base_value(leaves: Sequence[Leaf]) -> float:
    return float(sum(leaf.value * leaf.ratio.prod() for leaf in leaves))


@dataclass(frozen=True)
class Trees:
    """All trees of a model as one node table in arrays; a child's share is the part of its parent's rows it keeps."""

    roots: np.ndarray
    feature: np.ndarray  # -1 in leaves
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    value: np.ndarray  # of leaves, weighted
    gain: np.ndarray  # of splits, times the rows that reach them
    tree: np.ndarray

    def plain(self) -> tuple:
        """Plain arrays: what is sent to tasks is unpickled where this package may be absent."""
        return self.roots, self.feature, self.cut, self.left, self.right, self.share, self.value


def model_nodes(model: PipelineModel, df: DataFrame) -> Trees:
    """The node table of every tree, read from the saved model. Its size is that of the model, not of the data."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/model-{uuid.uuid4().hex}"
    trees = model.stages[-1]
    trees.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    nodes = nodes.select("treeID", "nodeData.*") if "nodeData" in nodes.columns else nodes.withColumn("treeID", F.lit(0))
    rows = sorted(nodes.collect(), key=lambda r: (r["treeID"], r["id"]))
    at = {(r["treeID"], r["id"]): i for i, r in enumerate(rows)}
    weights = list(trees.treeWeights)
    if isinstance(trees, RandomForestRegressionModel):  # a forest averages, boosting adds up
        weights = [w / sum(weights) for w in weights]
    if any(r["leftChild"] >= 0 and r["split"]["numCategories"] != -1 for r in rows):
        raise ValueError("categorical splits are not supported; encode categories as 0/1 columns")
    n = len(rows)
    left, right = (np.array([at.get((r["treeID"], r[c]), -1) for r in rows], int) for c in ("leftChild", "rightChild"))
    share = np.ones(n)
    count = np.array([r["rawCount"] for r in rows], float)
    for child in (left, right):
        inner = np.flatnonzero(child >= 0)
        share[child[inner]] = count[child[inner]] / count[inner]
    split = [r["leftChild"] >= 0 for r in rows]
    return Trees(
        np.array([at[t, 0] for t in range(len(weights))]),
        np.array([r["split"]["featureIndex"] if s else -1 for r, s in zip(rows, split)]),
        np.array([r["split"]["leftCategoriesOrThreshold"][0] if s else 0.0 for r, s in zip(rows, split)]),
        left, right, share,
        np.array([float(r["prediction"]) * weights[r["treeID"]] for r in rows]),
        np.array([r["gain"] * r["rawCount"] if s else 0.0 for r, s in zip(rows, split)]),
        np.array([r["treeID"] for r in rows]),
    )


def path_attributions(x: np.ndarray, trees: tuple, width: int) -> np.ndarray:
    """Shapley values of tree predictions under path-dependent expectations, and last the prediction.

    Averaging over feature subsets equals integrating, over t in (0,1), the product of
    (1-t) * ratio + t * inside across the other features of a leaf, a polynomial that Gauss-Legendre
    quadrature gives exactly. One walk over a tree serves all its leaves: the product at the
    quadrature nodes is carried down, sums over leaves are carried up, and an edge adds its feature's
    part for everything below it, taking back what an edge of the same feature above has added.
    """
    import numpy as np

    roots, feature, cut, left, right, share, value = trees
    n = len(x)
    phi = np.zeros((n, width + 1))

    def deepest(i: int, used: frozenset) -> int:
        if feature[i] < 0:
            return len(used)
        below = used | {feature[i]}
        return max(deepest(left[i], below), deepest(right[i], below))

    for root in roots.tolist():
        points = max(1, (deepest(root, frozenset()) + 1) // 2)
        nodes, weights = np.polynomial.legendre.leggauss(points)
        t, w = (nodes + 1) / 2, weights / 2
        factors: dict[int, tuple] = {}

        def walk(i: int, product: np.ndarray, reached: np.ndarray) -> np.ndarray:
            """Sum over the leaves below of value times product."""
            if feature[i] < 0:
                phi[:, width] += value[i] * reached
                return value[i] * product
            j = int(feature[i])
            low = x[:, j] <= cut[i]
            total = np.zeros_like(product)
            above = factors.get(j)
            for child, side in ((left[i], low), (right[i], ~low)):
                ratio, inside = share[child], side
                if above is not None:
                    ratio, inside = ratio * above[0], side & above[1]
                factor = (1 - t) * ratio + t * inside[:, None]
                factors[j] = (ratio, inside, factor)
                carried = product * factor if above is None else product * (factor / above[2])
                below = walk(int(child), carried, reached & side)
                total += below
                part = (inside - ratio)[:, None] / factor
                if above is not None:
                    part = part - (above[1] - above[0])[:, None] / above[2]
                phi[:, j] += (part * below) @ w
            if above is None:
                del factors[j]
            else:
                factors[j] = above
            return total

        walk(root, np.ones((n, points)), np.ones(n, bool))
    return phi


def tree_attributions(
    model: PipelineModel, df: DataFrame, features: Sequence[str], keys: Sequence[str], prefix: str = ""
) -> DataFrame:
    """Keys, one attribution per feature, the base value and the prediction they add up to, in one pass over ``df``."""
    found = model_nodes(model, df)
    shared = df.sparkSession.sparkContext.broadcast(found.plain())
    base = base_value(model_leaves_of(found))
    names, key_names = list(features), list(keys)
    data = df.select(*key_names, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)])
    schema = data.select(*key_names).schema
    out = [*[f"{prefix}{c}" for c in names], "base_value", "tree_prediction"]
    for c in out:
        schema = schema.add(c, "double")

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(key_names) :]])
            phi = path_attributions(x, shared.value, len(names))
            arrays = [*batch.columns[: len(key_names)], *[pa.array(phi[:, i]) for i in range(len(names))]]
            arrays += [pa.array(np.full(len(x), base)), pa.array(phi[:, -1])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*key_names, *out])

    return data.mapInArrow(partition, schema)


def gain_importance(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Impurity gains added up from the node table and scaled to 1; in a forest every tree weighs the same."""
    nodes = model_nodes(model, df)
    alike = isinstance(model.stages[-1], RandomForestRegressionModel)
    total = np.zeros(len(features))
    for k in np.unique(nodes.tree):
        mine = (nodes.tree == k) & (nodes.feature >= 0)
        gains = np.bincount(nodes.feature[mine], nodes.gain[mine], len(features))
        total += gains / gains.sum() if alike and gains.sum() > 0 else gains
    total = total / total.sum() if total.sum() > 0 else total
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, total)], "feature string, importance double")
