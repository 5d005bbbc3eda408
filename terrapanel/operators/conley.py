"""Sums of score products over all pairs of places within a distance.

Places are gathered into nested cells. A pair of cells that lies wholly within the
cutoff contributes the product of its two sums without being expanded, a pair wholly
outside contributes nothing, and only pairs on the border split into smaller cells.
Points sharing a coordinate are added up first. Small border cells are held as arrays of
places, so a row is always a pair of cells. The result is exact; single places are compared
only along the border of the cutoff circle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.scalars import EARTH_RADIUS_KM, KM_PER_DEGREE
from terrapanel.operators.moments import sum_of_vectors, sum_over_partitions
from terrapanel.session import checkpointed

#: Most pairs of places that a pair of border cells is compared over; larger ones split.
LEAF_PRODUCT = 1 << 14
MAX_LEVELS = 40


def _bound(dlat: Column, dlon: Column, cosine: Column, metric: str) -> Column:
    """Distance for given coordinate gaps and one cosine for both ends."""
    if metric == "spherical":
        a = F.sin(F.radians(dlat) / 2) ** 2 + cosine**2 * F.sin(F.radians(dlon) / 2) ** 2
        return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
    return F.sqrt(dlat * dlat + (cosine * dlon) ** 2) * F.lit(KM_PER_DEGREE)


def _cell(lon: Column, lat: Column, size: float) -> Column:
    return F.struct(F.floor((lat + 90.0) / size).alias("y"), F.floor((lon + 180.0) / size).alias("x"))


def _cells(points: DataFrame, size: float, names: Sequence[str], parent: str | None) -> DataFrame:
    """One row per cell: bounding box, number of places and score sums."""
    keyed = points.withColumn("cell", _cell(F.col("lon"), F.col("lat"), size))
    extra = [F.min(parent).alias("parent")] if parent else []
    return keyed.groupBy("cell").agg(
        *extra,
        F.min("lon").alias("w"),
        F.max("lon").alias("e"),
        F.min("lat").alias("s"),
        F.max("lat").alias("n"),
        F.count(F.lit(1)).alias("places"),
        *[F.sum(c).alias(c) for c in names],
    )


def _side(cells: DataFrame, tag: str) -> DataFrame:
    return cells.select(*[F.col(c).alias(f"{tag}_{c}") for c in cells.columns])


def _bounds(metric: str) -> tuple[Column, Column]:
    """Lower and upper bound of the distance between any two places of a cell pair."""
    aw, ae, as_, an = (F.col(f"a_{c}") for c in "wesn")
    bw, be, bs, bn = (F.col(f"b_{c}") for c in "wesn")
    zero = F.lit(0.0)
    lat_gap = F.greatest(zero, as_ - bn, bs - an)
    lat_span = F.greatest(an - bs, bn - as_)
    direct = F.greatest(zero, aw - be, bw - ae)
    around = F.greatest(zero, F.lit(360.0) - F.greatest(ae - bw, be - aw))
    lon_gap = F.least(direct, around)
    lon_span = F.least(F.greatest(ae - bw, be - aw), F.lit(180.0))
    top = F.greatest(F.abs(as_), F.abs(an), F.abs(bs), F.abs(bn))
    crosses = (F.least(as_, bs) <= 0) & (F.greatest(an, bn) >= 0)
    low = F.when(crosses, zero).otherwise(F.least(F.abs(as_), F.abs(an), F.abs(bs), F.abs(bn)))
    return (
        _bound(lat_gap, lon_gap, F.cos(F.radians(top)), metric),
        _bound(lat_span, lon_span, F.cos(F.radians(low)), metric),
    )


def _neighbours(cells: DataFrame, size: float, columns: int, reach_degrees: float) -> DataFrame:
    """Pairs of top-level cells that can hold places within reach, each pair once."""
    x, y = F.col("cell.x"), F.col("cell.y")
    up = int(math.ceil(reach_degrees / size)) + 1
    edge = F.least(F.greatest(F.abs("s"), F.abs("n")) + F.lit(reach_degrees + size), F.lit(89.9))
    wide = F.least(F.ceil(F.lit(reach_degrees / size) / F.cos(F.radians(edge))) + 1, F.lit(columns // 2 + 1))
    offsets = F.array_distinct(
        F.transform(F.sequence(-wide, wide), lambda d: F.pmod(x + d, F.lit(columns)).cast("bigint"))
    )
    return (
        cells.select(F.col("cell").alias("a"), y.alias("y"), offsets.alias("xs"))
        .withColumn("dy", F.explode(F.sequence(F.lit(-up), F.lit(up))))
        .withColumn("bx", F.explode("xs"))
        .select("a", F.struct((F.col("y") + F.col("dy")).alias("y"), F.col("bx").alias("x")).alias("b"))
        .filter("a <= b")
        .join(cells.select(F.col("cell").alias("b")), "b", "left_semi")
        .select("a", "b")
    )


def _pair_products(pairs: DataFrame, k: int) -> np.ndarray:
    """Sum over pairs of s_a s_b', with its transpose where the two sides differ."""
    cols = ["same"] + [f"a_s{i}" for i in range(k)] + [f"b_s{i}" for i in range(k)]

    def batch(m: np.ndarray) -> np.ndarray:
        same, a, b = m[:, :1], m[:, 1 : k + 1], m[:, k + 1 :]
        once = (a * same).T @ b
        twice = (a * (1 - same)).T @ b
        return once + twice + twice.T

    return sum_over_partitions(pairs, cols, batch, k * k).reshape(k, k)


def spatial_meat(
    scores: DataFrame,
    columns: Sequence[str],
    cutoff_km: float,
    lon: str = "lon",
    lat: str = "lat",
    metric: str = "triangular",
    pixel_km: float | None = None,
    leaf_product: int = LEAF_PRODUCT,
) -> np.ndarray:
    """Sum of s_g s_h' over ordered pairs of places at most ``cutoff_km`` apart.

    ``pixel_km`` first snaps places to squares of that size, an approximation that
    shrinks the number of places. Longitudes must lie in [-180, 180).
    """
    k = len(columns)
    names = [f"s{i}" for i in range(k)]
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    if pixel_km:
        step = pixel_km / KM_PER_DEGREE
        x, y = (F.floor(v / step) * step + step / 2 for v in (x, y))
    points = (
        scores.select(x.alias("lon"), y.alias("lat"), *[F.col(c).alias(n) for c, n in zip(columns, names)])
        .groupBy("lon", "lat")
        .agg(*[F.sum(n).alias(n) for n in names])
    )
    points = checkpointed(points)

    reach = cutoff_km / min(KM_PER_DEGREE, math.pi * EARTH_RADIUS_KM / 180.0)
    count = max(1, int(360.0 / reach))
    size = 360.0 / count
    cells = checkpointed(_cells(points, size, names, None))
    pairs = _neighbours(cells, size, count, reach)
    total = np.zeros((k, k))
    least, most = _bounds(metric)

    for level in range(MAX_LEVELS):
        sided = (
            pairs.join(_side(cells, "a"), F.col("a") == F.col("a_cell"))
            .join(_side(cells, "b"), F.col("b") == F.col("b_cell"))
            .withColumns({"same": (F.col("a") == F.col("b")).cast("double"), "lo": least, "hi": most})
            .filter(F.col("lo") <= cutoff_km * (1 + 1e-9))
        )
        sided = checkpointed(sided)
        within = F.col("hi") <= cutoff_km * (1 - 1e-9)
        total += _pair_products(sided.filter(within), k)
        border = sided.filter(~within)
        small = F.col("a_places") * F.col("b_places") <= leaf_product
        last = level == MAX_LEVELS - 1
        leaves = border if last else border.filter(small)
        total += _leaf_products(leaves.select("a", "b"), points, size, names, cutoff_km, metric)
        rest = border.filter(~small).select("a", "b")
        if last or rest.isEmpty():
            return total
        here = points.withColumn("parent", _cell(F.col("lon"), F.col("lat"), size))
        size /= 2.0
        cells = checkpointed(_cells(here, size, names, "parent"))
        kids = cells.select("parent", "cell")
        pairs = (
            rest.join(kids.select(F.col("parent").alias("a"), F.col("cell").alias("ca")), "a")
            .join(kids.select(F.col("parent").alias("b"), F.col("cell").alias("cb")), "b")
            .filter((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb")))
            .select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        )
    return total


def _leaf_products(
    leaves: DataFrame, points: DataFrame, size: float, names: Sequence[str], cutoff_km: float, metric: str
) -> np.ndarray:
    """Exact place pairs of small border cells. A row is a pair of cells; places stand in arrays inside it."""
    k = len(names)
    wanted = leaves.select("a").union(leaves.select("b")).distinct().select(F.col("a").alias("cell"))
    placed = points.withColumn("cell", _cell(F.col("lon"), F.col("lat"), size)).join(wanted, "cell", "left_semi")
    # At most ``leaf_product`` places stand in a cell of a leaf pair.
    held = placed.groupBy("cell").agg(F.collect_list(F.struct("lon", "lat", F.array(*names).alias("s"))).alias("p"))
    arrays = held.select("cell", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"), F.flatten("p.s").alias("s"))
    pairs = (
        leaves.withColumn("same", F.col("a") == F.col("b"))
        .join(_side(arrays, "a"), F.col("a") == F.col("a_cell"))
        .join(_side(arrays, "b"), F.col("b") == F.col("b_cell"))
        .select("same", "a_lon", "a_lat", "a_s", "b_lon", "b_lat", "b_s")
    )
    near = {"spherical": _haversine, "triangular": _flat}[metric]

    def batch(rows) -> np.ndarray:
        total = np.zeros((k, k))
        values, ends = [], []
        for c in rows.columns[1:]:
            values.append(c.flatten().to_numpy(zero_copy_only=False))
            ends.append(np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False)).tolist())
        for i, same in enumerate(rows.column(0).to_pylist()):
            lon_a, lat_a, s_a, lon_b, lat_b, s_b = (v[e[i - 1] if i else 0 : e[i]] for v, e in zip(values, ends))
            inside = near(lon_a[:, None], lat_a[:, None], lon_b, lat_b) <= cutoff_km
            part = s_a.reshape(-1, k).T @ (inside @ s_b.reshape(-1, k))
            # a cell with itself already has every pair in both orders
            total += part if same else part + part.T
        return total

    return sum_of_vectors(pairs, batch, k * k).reshape(k, k)


def _flat(lon1, lat1, lon2, lat2):
    dlon = np.abs(lon1 - lon2)
    dlon = np.minimum(dlon, 360.0 - dlon)
    return np.hypot(lat1 - lat2, np.cos(np.radians((lat1 + lat2) / 2)) * dlon) * KM_PER_DEGREE


def _haversine(lon1, lat1, lon2, lat2):
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(a, 1.0)))
