"""Mutual information by nearest neighbours.

For every row the distance to its k-th neighbour in the plane of feature and target (largest of
the two gaps) sets a radius; the information follows from how many rows lie within it on either
axis alone. Equal points become one with a weight. The plane is cut into cells of about equal
size, strips of the feature and parts of each strip; a point's radius within its own cell bounds
the cells that can hold anything nearer, so each point visits only these. Counts on an axis need
the strips at the two ends of the radius and running totals of the strips between.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.scalars import complete_rows
from terrapanel.session import checkpointed, release

#: Points of a cell or strip, about, and points asked together inside a cell.
CELL = 2000
BLOCK = 32
_SHIFT = 10


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the log of the gamma function at positive numbers."""
    x = np.asarray(x, dtype=float)
    out = np.zeros_like(x)
    for _ in range(_SHIFT):  # move to arguments where the series below is exact to the last digits
        small = x < _SHIFT
        out = np.where(small, out - 1 / x, out)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    series = f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f * (1 / 132 - f * (691 / 32760 - f / 12))))))
    return out + np.log(x) - 0.5 / x - series


def _index(v: Column, cuts: Sequence[float]) -> Column:
    """How many of the sorted cuts are less."""
    held = np.array(cuts, dtype=float)
    return F.pandas_udf(lambda x: pd.Series(np.searchsorted(held, x.to_numpy(dtype=float)).astype("int32")), "int")(v)


def _cuts(df: DataFrame, column: str, parts: int) -> list[float]:
    if parts < 2:
        return []
    probs = [i / parts for i in range(1, parts)]
    return sorted(set(df.agg(F.percentile_approx(column, probs, 8 * parts)).first()[0] or []))


def _nearest(points: pd.DataFrame, asked: pd.DataFrame, k: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each asked point the distances of its nearest points, ascending, and their weights: ``k`` + 1 columns or fewer.

    Points asked together lie close by one another. A few points near their box bound the distances, and
    only points within that bound of the box are compared.
    """
    x, y, w = (points[c].to_numpy() for c in ("x", "y", "w"))
    ax, ay = asked["x"].to_numpy(), asked["y"].to_numpy()
    m = min(k + 1, len(x))
    few = min(len(x), 4 * BLOCK + m)
    strip = max(1, math.isqrt(len(ax) * BLOCK))
    order = np.argsort(ax, kind="stable")
    order = order[np.lexsort((ay[order], np.arange(len(ax)) // strip))]
    distance, weight = np.empty((len(ax), m)), np.empty((len(ax), m), dtype=np.int64)
    for lo in range(0, len(ax), BLOCK):
        rows = order[lo : lo + BLOCK]
        u, v = ax[rows, None], ay[rows, None]
        away = np.maximum(np.maximum(u.min() - x, x - u.max()), np.maximum(v.min() - y, y - v.max()))
        near = np.arange(len(x)) if few == len(x) else np.argpartition(away, few - 1)[:few]
        d = np.maximum(np.abs(x[near] - u), np.abs(y[near] - v))
        if few < len(x):
            bound = np.partition(d, m - 1, axis=1)[:, m - 1].max()
            # The gap to the box may be off in its last digit against the distance to a point.
            near = np.flatnonzero(away <= bound * (1 + 1e-12))
            d = np.maximum(np.abs(x[near] - u), np.abs(y[near] - v))
        at = np.argpartition(d, m - 1, axis=1)[:, :m]
        found = np.take_along_axis(d, at, 1)
        sort = np.argsort(found, axis=1, kind="stable")
        distance[rows] = np.take_along_axis(found, sort, 1)
        weight[rows] = w[near[np.take_along_axis(at, sort, 1)]]
    if own:  # a row is no neighbour of its own; its equals are
        weight[:, 0] -= 1
    return distance, weight


def _kth(distance: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Distance at which each row's weights add up to ``k``; infinite if they do not."""
    reached = np.cumsum(weight, axis=1) >= k
    return np.where(reached.any(1), np.take_along_axis(distance, reached.argmax(1)[:, None], 1)[:, 0], math.inf)


def _cells_abroad(p: pd.DataFrame, r: np.ndarray, xs: np.ndarray, cuts: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Of each point the other cells, as ``s << 32 | c``, that can hold something nearer than its radius."""
    x, y, s, c = (p[n].to_numpy() for n in ("x", "y", "s", "c"))
    first, last = np.searchsorted(xs, x - r), np.searchsorted(xs, x + r)
    at, code = [], []
    for t in range(int(first.min()), int(last.max()) + 1):
        rows = np.flatnonzero((first <= t) & (t <= last))
        if t not in cuts or not len(rows):
            continue
        low, high = np.searchsorted(cuts[t], y[rows] - r[rows]), np.searchsorted(cuts[t], y[rows] + r[rows])
        n = high - low + 1
        who = np.repeat(rows, n)
        cell = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        other = (s[who] != t) | (c[who] != cell)
        at.append(who[other])
        code.append((np.int64(t) << 32) + cell[other])
    if not at:
        return [np.empty(0, np.int64)] * len(p)
    at, code = np.concatenate(at), np.concatenate(code)
    order = np.argsort(at, kind="stable")
    return np.split(code[order], np.cumsum(np.bincount(at, minlength=len(p)))[:-1])


def neighbour_radius(points: DataFrame, k: int = 3, cell: int = CELL) -> DataFrame:
    """Adds to distinct weighted points (id, x, y, w) the distance r of the k-th neighbour; infinite with fewer rows."""
    n = points.count()
    strips = max(1, math.isqrt(max(1, n // cell)))
    xs = np.array(_cuts(points, "x", strips))
    striped = points.withColumn("s", _index(F.col("x"), xs))
    largest = striped.groupBy("s").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-largest // cell))
    probs = [i / parts for i in range(1, parts)]
    # one row a strip, with its cuts of the other axis: a number a cell
    cut = (
        striped.groupBy("s").agg(F.array_distinct(F.percentile_approx("y", probs, 8 * parts)).alias("cuts"))
        if parts > 1 else striped.select("s").distinct().withColumn("cuts", F.array().cast("array<double>"))
    )
    cuts = {r["s"]: np.array(r["cuts"], dtype=float) for r in cut.collect()}

    def part(s: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(s), dtype="int32")
        for t in s.unique():
            mine = (s == t).to_numpy()
            out[mine] = np.searchsorted(cuts[t], y.to_numpy(dtype=float)[mine])
        return pd.Series(out)

    placed = checkpointed(striped.withColumn("c", F.pandas_udf(part, "int")("s", "y")))
    schema = "id long, x double, y double, w long, d array<double>, dw array<long>, r double, abroad array<long>"

    def inside(p: pd.DataFrame) -> pd.DataFrame:
        d, w = _nearest(p, p, k, own=True)
        out = p[["id", "x", "y", "w"]].copy()
        out["d"], out["dw"], out["r"] = list(d), list(w), _kth(d, w, k)
        out["abroad"] = _cells_abroad(p, out["r"].to_numpy(), xs, cuts)
        return out

    local = checkpointed(placed.groupBy("s", "c").applyInPandas(inside, schema))
    settled = local.filter(F.size("abroad") == 0).select("id", "x", "y", "w", "r")
    unsettled = local.filter(F.size("abroad") > 0)

    def visit(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "d": pd.Series(dtype=object), "dw": pd.Series(dtype=object)})
        d, w = _nearest(p, q, k, own=False)
        return pd.DataFrame({"id": q["id"].to_numpy(), "d": list(d), "dw": list(w)})

    asked = unsettled.select("id", "x", "y", F.explode("abroad").alias("_go")).select(
        F.shiftright("_go", 32).cast("int").alias("s"), F.col("_go").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("c"), "id", "x", "y"
    )
    answers = placed.select("s", "c", "x", "y", "w").groupBy("s", "c").cogroup(asked.groupBy("s", "c")).applyInPandas(
        visit, "id long, d array<double>, dw array<long>"
    )
    every = unsettled.select("id", "d", "dw").unionByName(answers).select("id", F.explode(F.arrays_zip("d", "dw")).alias("e"))
    # Per point at most k + 1 entries of each cell visited.
    lists = every.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("e.d", "e.dw"))).alias("e"))
    reached = F.aggregate(
        "e", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("r")),
        lambda a, e: F.struct((a["n"] + e["dw"]).alias("n"), F.when((a["n"] < k) & (a["n"] + e["dw"] >= k), e["d"]).otherwise(a["r"]).alias("r")),
    )
    out = lists.select("id", F.coalesce(reached["r"], F.lit(math.inf)).alias("r"))
    return settled.unionByName(unsettled.select("id", "x", "y", "w").join(out, "id"))


def axis_counts(points: DataFrame, axis: str, output: str, strip: int = CELL) -> DataFrame:
    """Adds to weighted points with radius r how many other rows lie nearer than r on one axis (as near, where r is 0)."""
    values = checkpointed(points.groupBy(F.col(axis).alias("v")).agg(F.sum("w").alias("w")))
    n = values.count()
    cuts = _cuts(values, "v", max(1, n // strip))
    dealt = values.withColumn("s", _index(F.col("v"), cuts))
    # one row a strip
    totals = dealt.groupBy("s").agg(F.sum("w").alias("w")).orderBy("s").collect()
    before, run = {}, 0
    for row in totals:
        before[row["s"]] = run
        run += row["w"]
    ends = [row["s"] for row in totals]
    bounds = np.array(ends + [math.inf])
    running = np.array([before[s] for s in ends] + [run])
    asked = points.select("id", F.col(axis).alias("v"), "r")
    both = None
    for side, sign in ((0, -1.0), (1, 1.0)):
        part = asked.withColumns({"s": _index(F.col("v") + F.lit(sign) * F.col("r"), cuts), "side": F.lit(side)})
        both = part if both is None else both.unionByName(part)
    # A strip with many questions is asked by several tasks, so that its values are copied once for every 100 strips of questions.
    both = checkpointed(both)
    salts = both.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / F.lit(100 * strip)).alias("salts"))
    salts = F.broadcast(checkpointed(salts))  # one row a strip
    both = both.join(salts, "s").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))).drop("salts")
    held = dealt.join(salts, "s").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).drop("salts")

    def count(key, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if q.empty:
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "side": [], "n": []})
        p = p.sort_values("v")
        v, sums = p["v"].to_numpy(), np.concatenate([[0], np.cumsum(p["w"].to_numpy())])
        mid, r, right = q["v"].to_numpy(), q["r"].to_numpy(), q["side"].to_numpy() == 1
        at = np.searchsorted(v, np.where(right, mid + r, mid - r))

        def counted(i: np.ndarray) -> np.ndarray:
            """Whether value ``i`` lies below the end of the interval."""
            gap = np.abs(v[i] - mid) if len(v) else np.zeros(len(i))
            near = (gap < r) | (gap == 0)
            return np.where(right, (v[i] < mid) | near, (v[i] < mid) & ~near)

        # The sum may be off in its last digit; the gaps themselves decide.
        for _ in range(3):
            if len(v):
                at = np.where((at < len(v)) & counted(np.minimum(at, len(v) - 1)), at + 1, at)
                at = np.where((at > 0) & ~counted(np.maximum(at - 1, 0)), at - 1, at)
        start = running[np.searchsorted(bounds, key[0])]
        return pd.DataFrame({"id": q["id"].to_numpy(), "side": q["side"].to_numpy(), "n": start + sums[at]})

    found = held.groupBy("s", "salt").cogroup(both.groupBy("s", "salt")).applyInPandas(count, "id long, side int, n long")
    ends_of = found.groupBy("id").agg((F.max(F.when(F.col("side") == 1, F.col("n"))) - F.max(F.when(F.col("side") == 0, F.col("n"))) - 1).alias(output))
    return points.join(ends_of, "id")


def neighbour_information(
    df: DataFrame, features: Sequence[str], target: str, k: int = 3, cell: int = CELL, standardize: bool = True
) -> DataFrame:
    """(feature, importance): mutual information in nats of each feature with the target, by k nearest neighbours.

    Both are divided by their standard deviation, unless ``standardize`` is off. Rows with either missing are left out; a constant side, or
    no more than ``k`` rows, has no information. No noise is added, so equal rows are at distance 0.
    """
    out = None
    for f in features:
        pair = complete_rows(df.select(F.col(f).cast("double").alias("x"), F.col(target).cast("double").alias("y")))
        sx, sy, n = pair.agg(F.stddev_pop("x"), F.stddev_pop("y"), F.count(F.lit(1))).first()
        if n <= k or not sx or not sy:
            rows = df.sparkSession.createDataFrame([(f, 0.0)], "feature string, importance double")
        else:
            sx, sy = (sx, sy) if standardize else (1.0, 1.0)
            points = pair.select((F.col("x") / sx).alias("x"), (F.col("y") / sy).alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
            points = checkpointed(checkpointed(points).withColumn("id", F.monotonically_increasing_id()))
            reach = checkpointed(neighbour_radius(points, k, cell))
            counted = checkpointed(axis_counts(axis_counts(reach, "x", "nx", cell), "y", "ny", cell))
            # Weights by pairs of counts: digamma is taken once a count.
            psi = F.pandas_udf(lambda v: pd.Series(digamma(v.to_numpy(dtype=float) + 1)), "double")
            mean = counted.agg((F.sum(F.col("w") * (psi("nx") + psi("ny"))) / n).alias("m"))
            base = float(digamma(np.array([float(n)]))[0] + digamma(np.array([float(k)]))[0])
            rows = mean.select(F.lit(f).alias("feature"), F.greatest(F.lit(0.0), F.lit(base) - F.col("m")).alias("importance"))
            rows = checkpointed(rows)
            release(points, reach, counted)
        out = rows if out is None else out.unionByName(rows)
    return out
