"""Correlations with a target, between columns, and with significance."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terrapanel.functions.distributions import stars, t_two_sided_p
from terrapanel.functions.scalars import complete_rows
from terrapanel.operators.moments import pairwise_correlation
from terrapanel.operators.quantiles import first_row_of, exact_quantiles
from terrapanel.session import checkpointed


def target_correlation(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, correlation, abs_correlation), one aggregation for all features.

    Pairs with a missing side are skipped; a constant feature has a NULL correlation.
    """
    structs = []
    for c in features:
        x, y = F.col(c).cast("double"), F.col(target).cast("double")
        both = x.isNotNull() & y.isNotNull()
        r = F.corr(F.when(both, x), F.when(both, y))
        r = F.when(~F.isnan(r), r)
        structs.append(F.struct(F.lit(c).alias("feature"), r.alias("correlation")))
    return (
        df.agg(F.array(*structs).alias("r"))
        .select(F.inline("r"))
        .withColumn("abs_correlation", F.abs("correlation"))
    )


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long correlation matrix (x, y, r, n) over pairwise complete rows."""
    r, n = pairwise_correlation(df, columns)
    rows = [
        (a, b, None if math.isnan(r[i, j]) else float(r[i, j]), int(n[i, j]))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double, n long")


def average_ranks(df: DataFrame, columns: Sequence[str], rows_per_range: int = 1_000_000) -> DataFrame:
    """Replace each column by its average rank, ties sharing the mean of their places.

    One long table of (row, column, value) is dealt to ranges of values, all columns in one shuffle,
    ranked inside each range and brought back to rows. A value so frequent that a sketch meets it
    twice gets its rank from a plain count and is not dealt at all, so a range never holds a run of
    ties longer than itself. Missing values and NaN have no rank.
    """
    columns = list(columns)
    values = [F.col(c).cast("double") for c in columns]
    data = df.select("*", *[F.when(~F.isnan(v), v).alias(f"_v{i}") for i, v in enumerate(values)])
    # Stored, so that a row keeps its number.
    data = checkpointed(data.withColumn("_row", F.monotonically_increasing_id()))
    cuts, frequent = _rank_ranges(data, len(columns), rows_per_range)
    facts = iter(first_row_of(data, [
        a for i in range(len(columns)) for h in frequent[i]
        for a in (F.count_if(F.col(f"_v{i}") < F.lit(h)), F.count_if(F.col(f"_v{i}") == F.lit(h)))
    ]) if any(frequent) else [])
    counted = [[(h, next(facts), next(facts)) for h in hs] for hs in frequent]
    own, rest, place, known = [], [], [], []
    for i in range(len(columns)):
        v, rank = F.col(f"_v{i}"), F.lit(None).cast("double")
        for h, less, equal in counted[i]:
            rank = F.when(v == F.lit(h), F.lit(less + (equal + 1) / 2.0)).otherwise(rank)
        own.append(rank)
        rest.append(F.when(rank.isNull(), v))
        place.append(_range_index(v, cuts[i]) if cuts[i] else F.lit(0))
        # rows of frequent values that lie below each range
        known += [(i, b, sum(n for h, _, n in counted[i] if h <= cuts[i][b - 1])) for b in range(1, len(cuts[i]) + 1)]
    entries = F.array(*[
        F.struct(F.lit(i).alias("c"), rest[i].alias("v"), place[i].alias("b"), own[i].alias("rank")) for i in range(len(columns))
    ])
    long = data.select("_row", F.explode(entries).alias("e")).select("_row", "e.*").filter("v IS NOT NULL OR rank IS NOT NULL")
    open_rows = long.filter("rank IS NULL").drop("rank")
    spark = df.sparkSession
    # at most one row a range and column
    sizes = open_rows.groupBy("c", "b").agg(F.count(F.lit(1)).alias("n"))
    known_rows = spark.createDataFrame(known or [(0, 0, 0)], "c int, b int, k long")
    before = sizes.join(known_rows, ["c", "b"], "left").select(
        "c", "b", (F.coalesce("k", F.lit(0)) + F.sum("n").over(W.partitionBy("c").orderBy("b")) - F.col("n")).alias("before")
    )
    inside = W.partitionBy("c", "b").orderBy("v")
    # The first place of a run of ties and the last one, the window's default end being the run's.
    middle = (F.rank().over(inside) + F.count(F.lit(1)).over(inside)) / 2.0
    ranked = open_rows.withColumn("m", middle).join(before, ["c", "b"]).select("_row", "c", (F.col("before") + F.col("m")).alias("rank"))
    both = ranked.unionByName(long.filter("rank IS NOT NULL").select("_row", "c", "rank"))
    wide = both.groupBy("_row").agg(*[F.max(F.when(F.col("c") == i, F.col("rank"))).alias(f"_r{i}") for i in range(len(columns))])
    others = [c for c in df.columns if c not in columns]
    out = data.select("_row", *others).join(wide, "_row", "left")
    return out.select(*[F.col(f"_r{columns.index(c)}").alias(c) if c in columns else F.col(c) for c in df.columns])


#: Ranges of values of one column.
MOST_RANGES = 4096


def _rank_ranges(data: DataFrame, k: int, rows_per_range: int) -> tuple[list[list[float]], list[list[float]]]:
    """Cut points of each column, and those values that a sketch meets at two neighbouring steps or more."""
    n = data.count()
    ranges = min(MOST_RANGES, max(16, n // rows_per_range))
    probs = [i / ranges for i in range(1, ranges)]
    rows = data.agg(*[F.percentile_approx(f"_v{i}", probs, 8 * ranges).alias(f"a{i}") for i in range(k)]).first()
    cuts, frequent = [], []
    for found in rows:
        found = list(found or [])
        cuts.append(sorted(set(found)))
        frequent.append(sorted({a for a, b in zip(found, found[1:]) if a == b}))
    return cuts, frequent


def _range_index(value: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points below ``value``."""
    if len(cuts) <= 32:  # plain comparisons compile; a lambda over an array does not
        return sum(((value > F.lit(float(c))).cast("int") for c in cuts), F.lit(0))
    array = F.expr("array(" + ", ".join(f"{float(c)!r}D" for c in cuts) + ")")
    return F.size(F.filter(array, lambda c: c < value))


def significance_table(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Pairs with r, n, two-sided p and stars. Spearman ranks rows complete in ``columns``."""
    data = df.select(*columns)
    if method == "spearman":
        data = average_ranks(complete_rows(data), columns)
    r, n = pairwise_correlation(data, columns)
    rows = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            rij, nij = float(r[i, j]), int(n[i, j])
            p: float | None = None
            if i != j and not math.isnan(rij) and nij > 2:
                gap = max(1.0 - rij * rij, 0.0)
                t = math.inf if gap == 0 else rij * math.sqrt((nij - 2) / gap)
                p = t_two_sided_p(t, nij - 2)
            rows.append((a, b, None if math.isnan(rij) else rij, nij, p, stars(p)))
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double, n long, p double, stars string")


def formatted_matrix(table: DataFrame, columns: Sequence[str], digits: int = 3, keep: str = "all") -> DataFrame:
    """Wide text matrix with stars; ``keep`` masks one triangle ('upper' or 'lower')."""
    order = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    i, j = order[F.col("x")], order[F.col("y")]
    text = F.concat(F.format_number("r", digits), F.col("stars"))
    if keep == "upper":
        text = F.when(i <= j, text).otherwise("")
    elif keep == "lower":
        text = F.when(i >= j, text).otherwise("")
    cells = table.select("x", "y", text.alias("cell"))
    return cells.groupBy("x").pivot("y", list(columns)).agg(F.first("cell")).orderBy(order[F.col("x")])


def strongest_partner(pairs: DataFrame, features: Sequence[str]) -> DataFrame:
    """For each feature the other column with the largest absolute correlation."""
    candidates = pairs.filter(F.col("x").isin(*features) & (F.col("x") != F.col("y")) & F.col("r").isNotNull())
    best = F.max(F.struct(F.abs("r").alias("a"), F.col("y"), F.col("r")))
    return candidates.groupBy("x").agg(best.alias("m")).select(
        F.col("x").alias("feature"), F.col("m.y").alias("partner"), F.col("m.r").alias("r")
    )


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int = 16) -> DataFrame:
    """Plug-in mutual information in nats over equal-frequency bins; ``neighbours.py`` has the other estimator.

    One contingency aggregation for all features: at most features x bins^2 groups.
    """
    probs = [i / bins for i in range(1, bins)]
    cuts = exact_quantiles(df, [*features, target], probs)

    def code(name: str) -> Column:
        edges = sorted({c for c in cuts[name] if c is not None})
        return _range_index(F.col(name).cast("double"), edges) if edges else F.lit(0)

    ready = df.select(
        code(target).alias("yb"),
        *[F.when(F.col(f).isNotNull(), code(f)).alias(f) for f in features],
        F.col(target).isNotNull().alias("_ok"),
    ).filter("_ok")
    cells = (
        ready.select("yb", *features)
        .unpivot(["yb"], list(features), "feature", "xb")
        .filter(F.col("xb").isNotNull())
        .groupBy("feature", "xb", "yb")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    # bounded by features x bins^2 cells
    nx = F.sum("n").over(W.partitionBy("feature", "xb"))
    ny = F.sum("n").over(W.partitionBy("feature", "yb"))
    nn = F.sum("n").over(W.partitionBy("feature"))
    scored = cells.select("feature", (F.col("n") / nn * F.log(F.col("n") * nn / (nx * ny))).alias("term"))
    return scored.groupBy("feature").agg(F.greatest(F.sum("term"), F.lit(0.0)).alias("importance"))
