"""Exact top-k inner products by best-first search in M-trees.

Vectors become integers and are dealt out to forests of M-trees of bounded size. A tree is paged:
each node keeps the pivots of its children, their covering radii, their distances to the node's
own pivot and the largest norm below them; leaves keep the distances of their vectors to the
pivot. Since 2 q.x = |q|^2 + |x|^2 - d(q, x)^2 and also q.x <= q.p + |q| r, a radius gives an upper
bound of the product; with the page's own pivot p so does q.x <= q.p + |q| d(x, p). A block of queries
searches a tree together: it takes the page most promising to any of them first and drops, query
by query, pages and vectors whose stored distances already rule them out.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.session import checkpointed

SCALE = 1024
#: Vectors of a leaf page, children of an inner page, vectors of a tree, queries of a block.
LEAF = 64
FANOUT = 16
TREE_ROWS = 16_384
BLOCK_QUERIES = 512
# Covers the rounding of square roots: products are integers, so less than one half is safe.
_SLACK = 0.25


def quantised(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id and v: floor(scale * x) of each component; rows with null or non-finite parts are left out."""
    x = F.col(vector).cast("array<double>")
    sound = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    )
    return df.filter(sound).select(F.col(key).cast("bigint").alias("id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def _distance(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - p).astype(np.float64) ** 2).sum(axis=-1))


def build(ids: np.ndarray, x: np.ndarray, pivot: np.ndarray, pages: list[dict]) -> int:
    """Bulk load into ``pages`` and return the new page's number.

    Pivots are spread by farthest-first choice, vectors go to the nearest, and so on below. An
    inner page has pivots, radii, parents (distances to its own pivot), norms (largest below) and
    children; a leaf has vectors as pivots and their ids.
    """
    number = len(pages)
    pages.append({})
    d = _distance(x, pivot)
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    chosen, nearest, which = [], np.full(len(ids), np.inf), np.zeros(len(ids), dtype=np.int64)
    if len(ids) > LEAF:
        for k in range(FANOUT):
            at = int(np.argmax(nearest if k else d))
            if k and nearest[at] == 0:
                break
            chosen.append(at)
            away = _distance(x, x[at])
            closer = away < nearest
            nearest[closer], which[closer] = away[closer], k
    if len(chosen) < 2:  # few vectors, or many equal ones
        pages[number] = {"pivots": x, "radii": np.zeros(len(ids)), "parents": d, "norms": norms, "ids": ids}
        return number
    mine = [np.flatnonzero(which == k) for k in range(len(chosen))]
    pages[number] = {
        "pivots": x[chosen],
        "radii": np.array([nearest[m].max() for m in mine]),
        "parents": d[chosen],
        "norms": np.array([norms[m].max() for m in mine]),
        "children": [build(ids[m], x[m], x[at], pages) for m, at in zip(mine, chosen)],
    }
    return number


def search(pages: list[dict], pivot: np.ndarray, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The ``k`` best (score, -id), ties to the smaller id, of the vectors other than the query's own."""
    return search_block(pages, pivot, np.array([query_id]), q[None, :], k)[0]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products; in floating point, which is faster, where that is exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def search_block(pages: list[dict], pivot: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query the ``k`` best (score, -id) of the vectors other than its own, ties to the smaller id.

    All queries share the pages: the page of the greatest promise to any query comes first and is read
    once, by the queries to which it still promises more than their k-th best.
    """
    n = len(ids)
    best: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # heaps whose first entry is the worst kept
    floor = np.full(n, -math.inf)
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    everyone = np.arange(n)
    # promise, tie-break, page, its queries, their promises, distances to and products with its pivot
    queue: list[tuple] = [(-math.inf, 0, 0, everyone, np.full(n, math.inf), _distance(q, pivot), _products(q, pivot[None, :])[:, 0])]
    made = 0
    while queue:
        _, _, number, mine, promise, away, with_pivot = heapq.heappop(queue)
        still = promise >= floor[mine]
        if not still.any():
            continue
        page = pages[number]
        mine, away, with_pivot = mine[still], away[still], with_pivot[still]
        size, low = norm[mine][:, None], floor[mine][:, None]
        # stored distances to the page's pivot bound products before any is computed
        gap = np.maximum(np.abs(away[:, None] - page["parents"]) - page["radii"] - 1e-6, 0.0)
        upper = np.minimum((size * size + page["norms"] ** 2 - gap * gap) / 2, size * page["norms"])
        upper = np.minimum(upper, with_pivot[:, None] + size * (page["parents"] + page["radii"]) * (1 + 1e-12)) + _SLACK + 1e-6 * size
        able = upper >= low
        rows, left = np.flatnonzero(able.any(axis=1)), np.flatnonzero(able.any(axis=0))
        if not len(rows):
            continue
        mine, pivots = mine[rows], page["pivots"][left]
        product = _products(q[mine], pivots)
        if "ids" in page:
            found = page["ids"][left]
            good = (product >= floor[mine][:, None]) & (found != ids[mine][:, None])
            for r in np.flatnonzero(good.any(axis=1)).tolist():
                i = mine[r]
                heap = best[i]
                at = np.flatnonzero(good[r])
                for score, own in zip(product[r, at].tolist(), found[at].tolist()):
                    entry = (score, -own)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                if len(heap) == k:
                    floor[i] = heap[0][0]
            continue
        size, low = norm[mine][:, None], floor[mine][:, None]
        radii, tops = page["radii"][left], page["norms"][left]
        p2 = (pivots.astype(np.float64) ** 2).sum(axis=1)
        far = np.sqrt(np.maximum(size * size + p2 - 2.0 * product, 0.0))
        reach = np.maximum(far - radii - 1e-6 * (1 + size), 0.0)
        below = np.minimum((size * size + tops * tops - reach * reach) / 2, product + size * radii) + _SLACK + 1e-6 * size
        below = np.minimum(below, upper[rows][:, left])
        for j, child in enumerate(left.tolist()):
            wanted = np.flatnonzero(below[:, j] >= low[:, 0])
            if len(wanted):
                made += 1
                entry = (-float(below[wanted, j].max()), made, page["children"][child], mine[wanted], below[wanted, j], far[wanted, j], product[wanted, j])
                heapq.heappush(queue, entry)
    return best


def _matrix(column) -> np.ndarray:
    """Lists of equal length as rows."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(np.int64)


def trees(vectors: DataFrame, n: int) -> DataFrame:
    """Stored M-trees of ``n`` forests dealt by hash, one for each length of vectors: dim, tree and its pickled pages."""
    dealt = vectors.withColumns({"tree": F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int"), "dim": F.size("v")})

    def make(table: pa.Table) -> pa.Table:
        x = _matrix(table["v"])
        pivot = np.floor(x.mean(axis=0)).astype(np.int64)
        pages: list[dict] = []
        build(table["id"].to_numpy(), x, pivot, pages)
        row = [pa.array([table[c][0].as_py()], pa.int32()) for c in ("dim", "tree")]
        return pa.table([*row, pa.array([pickle.dumps((pivot, pages))], pa.binary())], names=["dim", "tree", "pages"])

    return dealt.groupBy("dim", "tree").applyInArrow(make, "dim int, tree int, pages binary")


def blocks(queries: DataFrame, n: int) -> DataFrame:
    """Queries in ``n`` blocks for each length of vectors: dim, block, queries."""
    dealt = queries.withColumns({"block": F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int"), "dim": F.size("v")})
    return dealt.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("queries"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, tree_rows: int = TREE_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The ``k`` vectors of the largest products for each query: query_id, rank, vec_id, score.

    Both tables are ``quantised``. A query meets every tree of vectors of its length, a block of queries
    at a time, and leaves ``k`` rows there, which are merged by rank in two steps. Vectors of another
    length are no candidates. Repeated vectors tie and the smaller id wins; a repeated id is one
    candidate for each row, and none for a query of that id. Fewer candidates give fewer rows, none
    gives none.
    """
    laid = checkpointed(vectors.filter(F.size("v") > 0))
    asked = checkpointed(queries.filter(F.size("v") > 0).distinct())
    n_trees = max(1, -(-laid.count() // tree_rows))
    n_blocks = max(1, -(-asked.count() // block_queries))
    # the stated query set meets all trees in blocks: each tree is sent once for every block
    forest = trees(laid, n_trees).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = forest.join(blocks(asked, n_blocks), ["dim", "block"]).select("tree", "pages", "queries").repartition(max(n_trees * n_blocks, 2))

    def run(batches):
        names = ["tree", "query_id", "vec_id", "score"]
        for batch in batches:
            for i in range(batch.num_rows):
                tree = batch.column(0)[i].as_py()
                pivot, pages = pickle.loads(batch.column(1)[i].as_py())
                asked = batch.column(2)[i].values
                ids = asked.field("id").to_numpy(zero_copy_only=False)
                found = search_block(pages, pivot, ids, _matrix(asked.field("v")), k)
                rows = [(tree, int(q), -minus, score) for q, best in zip(ids, found) for score, minus in best]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    found = pairs.mapInArrow(run, "tree bigint, query_id bigint, vec_id bigint, score bigint")
    entry = F.struct(F.col("score"), (-F.col("vec_id")).alias("minus"))
    some = max(1, math.isqrt(n_trees))
    first = found.groupBy("query_id", F.pmod("tree", F.lit(some))).agg(F.slice(F.sort_array(F.collect_list(entry), asc=False), 1, k).alias("best"))
    merged = first.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).alias("rank"), (-F.col("b.minus")).alias("vec_id"), "b.score"
    )


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s) WHERE rank <= 10
"""
