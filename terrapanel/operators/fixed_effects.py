"""Fixed-effects least squares with robust standard errors.

A family of models of one target shares one stored table of complete rows. One effect (the largest)
is swept out by group means; small effects become explicit 0/1 columns, which by the Frisch-Waugh
theorem gives the same answer as absorbing them; further large effects are solved for by conjugate
gradients over their level means. One pass gives a cross-product matrix per row subset the models
use, from whose submatrices every model is solved, and one more pass the score sums per place or
cluster of all models together.

With one large effect the rows are dealt by it, and each pass stacks the subsets, adds the 0/1
columns and takes the means off inside its tasks, a batch of whole levels at a time: the stacked
table, several times as long and wide, is neither stored nor joined. With more it is stored.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.distributions import stars, t_two_sided_p
from terrapanel.functions.scalars import complete_rows
from terrapanel.operators.conley import spatial_meat
from terrapanel.operators.moments import gram, sum_of_vectors
from terrapanel.session import checkpointed, release

COLLINEAR_TOLERANCE = 1e-9
#: Rows of a batch of whole levels, about, and the most of a level that a task holds at once.
BATCH_ROWS = 1 << 14
HELD_ROWS = 1 << 15


@dataclass
class FixedEffectsFit:
    target: str
    terms: list[str]
    estimates: np.ndarray
    errors: np.ndarray
    dropped: list[str]
    n: int
    parameters: int
    r2: float
    within_r2: float
    effects: list[str]
    vcov: str
    covariance: np.ndarray
    degrees: float
    levels: dict[str, int] = field(default_factory=dict)
    rounds: int = 0

    def rows(self, model: str) -> list[tuple]:
        out = []
        for t, b, s in zip(self.terms, self.estimates, self.errors):
            p = t_two_sided_p(float(b / s), self.degrees) if s > 0 else math.nan
            out.append((model, t, float(b), float(s), None if math.isnan(p) else p, stars(p)))
        out += [(model, t, None, None, None, "") for t in self.dropped]
        return out


COEFFICIENT_SCHEMA = "model string, term string, estimate double, std_error double, p double, stars string"
STATISTICS_SCHEMA = (
    "model string, effects string, vcov string, n long, parameters long, r2 double, within_r2 double"
)


def coefficient_table(spark, fits: dict[str, FixedEffectsFit]) -> DataFrame:
    rows = [r for name, fit in fits.items() for r in fit.rows(name)]
    return spark.createDataFrame(rows, COEFFICIENT_SCHEMA)


def statistics_table(spark, fits: dict[str, FixedEffectsFit]) -> DataFrame:
    rows = [
        (name, " + ".join(f.effects), f.vcov, f.n, f.parameters, f.r2, f.within_r2) for name, f in fits.items()
    ]
    return spark.createDataFrame(rows, STATISTICS_SCHEMA)


def compare_coefficients(table: DataFrame, first: str, second: str) -> DataFrame:
    """Difference and percentage reduction between two models, term by term."""
    a = table.filter(F.col("model") == first).select("term", F.col("estimate").alias("first"))
    b = table.filter(F.col("model") == second).select("term", F.col("estimate").alias("second"))
    diff = F.col("first") - F.col("second")
    return a.join(b, "term").withColumns(
        {"difference": diff, "reduction_pct": F.try_divide(diff, F.col("first")) * 100}
    )


def interaction(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """Product columns named ``a:b``."""
    names = [f"{a}:{b}" for a, b in pairs]
    return df.withColumns({n: F.col(a) * F.col(b) for n, (a, b) in zip(names, pairs)}), names


def demean(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Subtract group means. Aggregate and join: a window would hold a whole group in one task."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    keep = [c for c in df.columns if c not in columns]
    return df.join(means, list(keys)).select(
        *keep, *[(F.col(f"`{c}`") - F.col(f"_m{i}")).alias(c) for i, c in enumerate(columns)]
    )


def sweep(
    df: DataFrame, effects: Sequence[Sequence[str]], columns: Sequence[str], tolerance: float = 1e-10, rounds: int = 500
) -> tuple[DataFrame, int]:
    """Remove several large effects, each given by its key columns; return also the rounds it took.

    The first effect goes by group means. The others' level coefficients solve the normal equations
    that remain; conjugate gradients, scaled by the levels' sizes, find them for all columns at
    once. A round passes over the table of effect combinations with their row counts, never over
    the columns themselves, and the vectors it keeps have one row per level.
    """
    out = demean(df, effects[0], columns)
    if len(effects) == 1:
        return out, 0
    k = len(columns)
    rows = checkpointed(out)
    keys = list(dict.fromkeys(c for e in effects for c in e))
    combos = checkpointed(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    base, others = list(effects[0]), [list(e) for e in effects[1:]]

    def stored(tables: list[DataFrame], before: list[DataFrame]) -> list[DataFrame]:
        kept = [checkpointed(t) for t in tables]
        release(*before)
        return kept

    def total(tables: list[DataFrame], term) -> np.ndarray:
        """Sums over all levels of all effects, one per column."""
        sums = np.zeros(k)
        for t in tables:
            sums += [v or 0.0 for v in t.agg(*[F.sum(term(i)) for i in range(k)]).first()]
        return sums

    def named(t: DataFrame, tag: str) -> list:
        return [F.col(f"{tag}{i}") for i in range(k)]

    state = [
        rows.groupBy(*e).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(f"`{c}`")).alias(f"r{i}") for i, c in enumerate(columns)])
        .select("*", *[F.lit(0.0).alias(f"x{i}") for i in range(k)], *[(F.col(f"r{i}") / F.col("_n")).alias(f"p{i}") for i in range(k)])
        for e in others
    ]
    state = stored(state, [])
    rho = total(state, lambda i: F.col(f"r{i}") ** 2 / F.col("_n"))
    start = np.maximum(rho, 1e-300)
    done = 0
    while (rho > tolerance**2 * start).any():
        if done == rounds:
            raise ArithmeticError(f"level means are left after {rounds} rounds")
        done += 1
        v = combos
        for j, (e, t) in enumerate(zip(others, state)):
            v = v.join(t.select(*e, *[F.col(f"p{i}").alias(f"_p{j}_{i}") for i in range(k)]), e)
        v = v.select(*keys, "_n", *[sum((F.col(f"_p{j}_{i}") for j in range(1, len(others))), F.col(f"_p0_{i}")).alias(f"v{i}") for i in range(k)])
        means = v.groupBy(*base).agg(*[(F.sum(F.col("_n") * F.col(f"v{i}")) / F.sum("_n")).alias(f"m{i}") for i in range(k)])
        left = v.join(means, base).select(*keys, *[(F.col("_n") * (F.col(f"v{i}") - F.col(f"m{i}"))).alias(f"a{i}") for i in range(k)])
        applied = [t.join(left.groupBy(*e).agg(*[F.sum(f"a{i}").alias(f"a{i}") for i in range(k)]), e) for e, t in zip(others, state)]
        applied = stored(applied, state)
        curve = total(applied, lambda i: F.col(f"p{i}") * F.col(f"a{i}"))
        active = (rho > tolerance**2 * start) & (curve > 0)
        alpha = np.where(active, rho / np.where(active, curve, 1.0), 0.0)
        moved = [
            t.select(
                *e, "_n", *[(F.col(f"x{i}") + float(alpha[i]) * F.col(f"p{i}")).alias(f"x{i}") for i in range(k)],
                *[(F.col(f"r{i}") - float(alpha[i]) * F.col(f"a{i}")).alias(f"r{i}") for i in range(k)], *named(t, "p"),
            )
            for e, t in zip(others, applied)
        ]
        new = total(moved, lambda i: F.col(f"r{i}") ** 2 / F.col("_n"))
        beta = np.where(active, new / np.where(rho > 0, rho, 1.0), 0.0)
        turned = [
            t.select(
                *e, "_n", *named(t, "x"), *named(t, "r"),
                *[(F.col(f"r{i}") / F.col("_n") + float(beta[i]) * F.col(f"p{i}")).alias(f"p{i}") for i in range(k)],
            )
            for e, t in zip(others, moved)
        ]
        state = stored(turned, applied)
        rho = np.where(active, new, 0.0)
    for j, (e, t) in enumerate(zip(others, state)):
        rows = rows.join(t.select(*e, *[F.col(f"x{i}").alias(f"_x{j}_{i}") for i in range(k)]), e)
    keep = [c for c in df.columns if c not in columns]
    gone = [sum((F.col(f"_x{j}_{i}") for j in range(1, len(others))), F.col(f"_x0_{i}")) for i in range(k)]
    rows = rows.select(*keep, *[(F.col(f"`{c}`") - g).alias(c) for c, g in zip(columns, gone)])
    return demean(rows, effects[0], columns), done


def independent_columns(g: np.ndarray, scale: np.ndarray, tolerance: float = COLLINEAR_TOLERANCE) -> list[int]:
    """Indices kept when columns that earlier ones explain are dropped, in order."""
    k = len(g)
    kept: list[int] = []
    for j in range(k):
        if g[j, j] <= tolerance * max(scale[j], 1e-300):
            continue
        if kept:
            sub = g[np.ix_(kept, kept)]
            d = np.sqrt(np.diag(sub))
            solved = np.linalg.lstsq(sub / np.outer(d, d), g[kept, j] / d, rcond=None)[0]
            rest = g[j, j] - (g[kept, j] / d) @ solved
            if rest <= tolerance * g[j, j]:
                continue
        kept.append(j)
    return kept


@dataclass(frozen=True)
class Model:
    """Regressors of one model of a family, and the name of its row subset (None: all rows)."""

    regressors: tuple[str, ...]
    rows: str | None = None


@dataclass
class _Solved:
    """A model solved from its group's cross products, with what its scores need."""

    group: int
    shown: list[int]  # columns of the estimates
    dummies: list[int]
    beta: np.ndarray
    bread: np.ndarray
    lead: np.ndarray  # regressors and target on the 0/1 columns
    rss: float
    null_rss: float


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def _solve(g: np.ndarray, group: int, dummies: list[int], xs: list[int], y: int, scale: np.ndarray) -> _Solved:
    order = [*dummies, *xs]
    kept = [order[j] for j in independent_columns(g[np.ix_(order, order)], scale[order])]
    d, x = [j for j in kept if j in set(dummies)], [j for j in kept if j in set(xs)]
    lead = np.linalg.solve(g[np.ix_(d, d)], g[np.ix_(d, [*x, y])]) if d else np.zeros((0, len(x) + 1))
    rest = g[np.ix_([*x, y], [*x, y])] - g[np.ix_([*x, y], d)] @ lead
    xx, xy, yy = rest[:-1, :-1], rest[:-1, -1], float(rest[-1, -1])
    size = np.sqrt(np.diag(xx))
    bread = np.linalg.inv(xx / np.outer(size, size)) / np.outer(size, size) if x else np.zeros((0, 0))
    beta = bread @ xy
    return _Solved(group, x, d, beta, bread, lead, yy - 2 * float(beta @ xy) + float(beta @ xx @ beta), yy)


def _scores(m: np.ndarray, solved: Sequence[_Solved], y: int) -> np.ndarray:
    """Regressors times residual of every model, side by side; zero in other models' rows. Column 0 is the group."""
    parts = []
    for s in solved:
        part = np.zeros((len(m), len(s.shown)))
        mine = m[:, 0] == s.group
        z = m[mine, 1:]
        rest = z[:, [*s.shown, y]] - z[:, s.dummies] @ s.lead
        part[mine] = rest[:, :-1] * (rest[:, -1] - rest[:, :-1] @ s.beta)[:, None]
        parts.append(part)
    return np.column_stack(parts)


def _stacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows of group and columns as they are stored, and the place of each in the batch."""
    return np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns]), np.arange(batch.num_rows)


def _deal(base: DataFrame, stack: DataFrame, conditions: Sequence[Column], levels: dict[str, list], keys: Sequence[str], values: Sequence[str]):
    """Rows dealt and sorted by the first effect, with what batches them by whole levels and sweeps a batch.

    Columns: the effect, ``h``, the keys, then as doubles the groups' marks, the codes of the small effects (0: the
    level without a column) and the values. A level of more than HELD_ROWS rows is spread over tasks; ``h`` numbers
    those levels, and their means come from an aggregation. They are at most the rows by HELD_ROWS.
    """
    spark, kinds = base.sparkSession, dict(base.dtypes)
    # -0.0 and 0.0 are one level
    effect = (F.col("fe0") + F.lit(0.0) if kinds["fe0"] in ("float", "double") else F.col("fe0")).alias("fe0")
    coded = [(F.array_position(F.array(*[F.lit(v) for v in found]), F.col(a)) if found else F.lit(0)).cast("double").alias(f"c_{a}") for a, found in levels.items()]
    marks = [F.coalesce(c, F.lit(False)).cast("double").alias(f"g{i}") for i, c in enumerate(conditions)]
    clean = [F.when(_present(v), F.col(v)).otherwise(0.0).alias(v) for v in values]
    rows = base.select(effect, *keys, *marks, *coded, *clean)
    large = [r[0] for r in rows.groupBy("fe0").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HELD_ROWS).select("fe0").collect()]
    groups, sizes = len(conditions), [len(found) for found in levels.values()]
    k = sum(sizes) + len(values)
    means = np.zeros((len(large) + 1, groups, k))
    order = ["fe0", "h", *keys, *[f"g{i}" for i in range(groups)], *[f"c_{a}" for a in levels], *values]
    if large:
        known = F.broadcast(spark.createDataFrame([(v, i) for i, v in enumerate(large, 1)], f"fe0 {kinds['fe0']}, h int"))
        rows = rows.join(known, "fe0", "left").withColumn("h", F.coalesce("h", F.lit(0)))
        dummies = [(F.col(a) == F.lit(v)).cast("double") for a, found in levels.items() for v in found]
        averages = [F.avg(c).alias(f"a{i}") for i, c in enumerate([*dummies, *[F.col(v) for v in values]])]
        for r in stack.join(known, "fe0").groupBy("h", "grp").agg(*averages).collect():
            means[r["h"], r["grp"]] = r[2:]
        spread = [F.when(F.col("h") > 0, F.pmod(F.xxhash64(*values), F.lit(1 << 20)))]
    else:
        rows, spread = rows.withColumn("h", F.lit(0)), []
    dealt = rows.select(*order).repartition("fe0", *spread).sortWithinPartitions("fe0")
    held, front = BATCH_ROWS, 2 + len(keys)

    def whole_levels(batches):
        """Batches that end where a level does, those of spread levels excepted."""
        kept: list[pa.RecordBatch] = []
        for b in batches:
            kept.append(b)
            if sum(x.num_rows for x in kept) < held:
                continue
            joined = pa.Table.from_batches(kept).combine_chunks()
            codes = joined.column(0).combine_chunks().dictionary_encode()
            codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
            end = len(codes) if joined.column(1)[-1].as_py() else int(np.flatnonzero(codes == codes[-1])[0])
            if end:
                yield from joined.slice(0, end).combine_chunks().to_batches()
            kept = joined.slice(end).to_batches()
        if kept:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()

    def swept(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Rows of group and columns less the means of group and level, and the place of each in the batch."""
        level = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        h = batch.column(1).to_numpy(zero_copy_only=False)
        m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[front:]])
        ones = [(m[:, [groups + j]] == np.arange(1, size + 1)).astype(float) for j, size in enumerate(sizes)]
        z = np.column_stack([*ones, m[:, groups + len(sizes) :]])
        parts, places = [], []
        for g in range(groups):
            place = np.flatnonzero(m[:, g])
            if not len(place):
                continue
            mine, of = z[place], level[place]
            first = np.flatnonzero(np.diff(of, prepend=-1))
            n = np.diff(first, append=len(of))
            mean = np.add.reduceat(mine, first, axis=0) / n[:, None]
            known = h[place[first]]
            mean[known > 0] = means[known[known > 0], g]
            parts.append(np.column_stack([np.full(len(mine), float(g)), mine - np.repeat(mean, n, axis=0)]))
            places.append(place)
        if not parts:
            return np.zeros((0, 1 + k)), np.zeros(0, np.int64)
        return np.concatenate(parts), np.concatenate(places)

    return dealt, whole_levels, swept


def _score_sums(
    work: DataFrame, keys: Sequence[str], columns: Sequence[str], solved: Sequence[_Solved], rebatch, swept
) -> tuple[DataFrame, list[str]]:
    """Scores of all models added up per key, first inside each batch."""
    names = [f"s{i}" for i in range(sum(len(s.shown) for s in solved))]
    y = len(columns) - 1

    def run(batches):
        for b in rebatch(batches):
            m, place = swept(b) if b.num_rows else (None, ())
            if not len(place):
                continue
            found = [b.column(b.schema.get_field_index(c)) for c in keys]
            code = np.zeros(b.num_rows, np.int64)
            for c in found:
                encoded = c.dictionary_encode()
                code = code * (len(encoded.dictionary) + 1) + encoded.indices.to_numpy(zero_copy_only=False)
            code = code[place]
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            sums = np.add.reduceat(_scores(m, solved, y)[order], first, axis=0)
            held = [c.take(pa.array(place[order[first]])) for c in found]
            yield pa.RecordBatch.from_arrays([*held, *[pa.array(v) for v in sums.T]], names=[*keys, *names])

    kinds = dict(work.dtypes)
    ddl = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], *[f"{n} double" for n in names]])
    part = work.mapInArrow(run, ddl)
    return part.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names]), names


def fit_family(
    df: DataFrame,
    target: str,
    models: Mapping[str, Model],
    effects: Sequence[str],
    subsets: Mapping[str, Column] | None = None,
    vcov: str = "iid",
    cluster: str | None = None,
    lon: str = "lon",
    lat: str = "lat",
    cutoff_km: float = 100.0,
    metric: str = "triangular",
    pixel_km: float | None = None,
    small_sample: bool = True,
    dummy_levels: int = 64,
    count_nested: bool = True,
) -> dict[str, FixedEffectsFit]:
    """Least squares of ``target`` for several sets of regressors and rows, with ``effects`` absorbed.

    ``vcov`` is 'iid', 'hetero', 'cluster' (needs ``cluster``) or 'conley', the last with a
    uniform kernel. Give the largest effect first; others of up to ``dummy_levels`` levels become
    0/1 columns, larger ones are solved for. A model leaves out rows with any value missing that it
    uses, and drops and reports regressors that the effects or earlier regressors explain. With
    ``count_nested`` off, the levels of effects that lie wholly inside clusters do not count as
    parameters in the small-sample factor of clustered errors.
    """
    subsets = dict(subsets or {})
    x_names = list(dict.fromkeys(x for m in models.values() for x in m.regressors))
    extra = {"cluster": [cluster], "conley": [lon, lat]}.get(vcov, [])
    alias = {c: f"v{i}" for i, c in enumerate([target, *x_names])}
    effect_alias = {e: f"fe{i}" for i, e in enumerate(effects)}
    keys = [f"x_{c}" for c in extra]
    # Written once: every later pass reads this narrow table, not the joins behind it.
    base = df.select(
        *[F.col(f"`{c}`").cast("double").alias(a) for c, a in alias.items()],
        *[F.col(e).alias(a) for e, a in effect_alias.items()],
        *[F.col(c).alias(k) for c, k in zip(extra, keys)],
        *[c.alias(f"in{i}") for i, c in enumerate(subsets.values())],
    )
    base = checkpointed(complete_rows(base, ["v0", *effect_alias.values(), *keys]))
    try:
        return _fit(
            base, target, dict(models), list(effects), list(subsets), alias, effect_alias, keys, vcov, cutoff_km, metric, pixel_km,
            small_sample, dummy_levels, count_nested,
        )
    finally:
        release(base)


def _groups(base: DataFrame, models: dict[str, Model], subsets: list[str], alias: dict[str, str]) -> list[tuple[Column, list[str]]]:
    """Models that use the same rows: the rows' condition and the models' names."""
    def condition(rows: str | None, names) -> Column:
        cond = F.coalesce(F.col(f"in{subsets.index(rows)}"), F.lit(False)) if rows is not None else F.lit(True)
        for x in names:
            cond = cond & _present(alias[x])
        return cond

    by_rows: dict = {}
    for name, m in models.items():
        by_rows.setdefault(m.rows, []).append(name)
    together = {r: condition(r, dict.fromkeys(x for n in names for x in models[n].regressors)) for r, names in by_rows.items()}
    alone = {n: condition(m.rows, m.regressors) for n, m in models.items()}
    counts = base.agg(*[F.count_if(c) for c in [*together.values(), *alone.values()]]).first()
    sizes = dict(zip([*[("all", r) for r in together], *alone], counts))
    found: list[tuple[Column, list[str]]] = []
    for r, names in by_rows.items():
        same = [n for n in names if sizes[n] == sizes["all", r]]
        if same:
            found.append((together[r], same))
        # The others lack values elsewhere; those of equal regressors share their rows.
        rest: dict = {}
        for n in names:
            if n not in same:
                rest.setdefault(frozenset(models[n].regressors), []).append(n)
        found += [(alone[n[0]], n) for n in rest.values()]
    return found


def _level_counts(stack: DataFrame, effects: list[str], cluster: str | None) -> dict[tuple[int, int], tuple[int, int]]:
    """For each group of rows and effect (-1: the cluster) its levels, and its pairs of level and cluster."""
    found = {}
    for i, a in enumerate(effects + ([cluster] if cluster else [])):
        pairs = stack.groupBy("grp", *dict.fromkeys([a, cluster or a])).agg(F.count(F.lit(1)).alias("c"))
        per = pairs.groupBy("grp", a).agg(F.count(F.lit(1)).alias("c")).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("homes"))
        found |= {(r["grp"], -1 if i == len(effects) else i): (r["n"], r["homes"]) for r in per.collect()}
    return found


def _fit(
    base, target, models, effects, subsets, alias, effect_alias, keys, vcov, cutoff_km, metric, pixel_km, small_sample, dummy_levels,
    count_nested,
) -> dict[str, FixedEffectsFit]:
    groups = _groups(base, models, subsets, alias)
    group_of = {n: g for g, (_, names) in enumerate(groups) for n in names}
    member = F.array_compact(F.array(*[F.when(c, g) for g, (c, _) in enumerate(groups)]))
    values = list(alias.values())
    stack = base.select(
        F.explode(member).alias("grp"), *effect_alias.values(), *keys,
        *[F.when(_present(v), F.col(v)).otherwise(0.0).alias(v) for v in values],
    )
    facts = {
        r["grp"]: r
        for r in stack.groupBy("grp").agg(
            F.count(F.lit(1)).alias("n"), F.var_pop("v0").alias("v"), *[F.avg(F.col(a) * F.col(a)).alias(f"q_{a}") for a in values]
        ).collect()
    }
    if len(facts) < len(groups):
        raise ValueError("no complete rows for " + ", ".join(n for n, g in group_of.items() if g not in facts))
    sizes = _level_counts(stack, list(effect_alias.values()), keys[0] if vcov == "cluster" else None)
    most = [max(sizes[g, i][0] for g in range(len(groups))) for i in range(len(effects))]
    large = [0, *[i for i in range(1, len(effects)) if most[i] > dummy_levels]]
    dummies: list[str] = []
    coded: dict[str, list] = {}
    for i in range(1, len(effects)):
        if i in large:
            continue
        # at most dummy_levels rows for each group
        a = f"fe{i}"
        found = [r[0] for r in base.select(a).distinct().orderBy(a).collect()][1:]
        coded[a] = found
        dummies += [f"d_{a}_{j}" for j in range(len(found))]
    columns = [*dummies, *values[1:], "v0"]
    if len(large) == 1:
        rounds = 0
        work, rebatch, swept = _deal(base, stack, [c for c, _ in groups], coded, keys, [*values[1:], "v0"])
    else:
        ones = [(F.col(a) == F.lit(v)).cast("double") for a, found in coded.items() for v in found]
        stack = checkpointed(stack)
        wide = stack.select("*", *[c.alias(d) for c, d in zip(ones, dummies)])
        wide, rounds = sweep(wide.select("grp", *[f"fe{i}" for i in large], *keys, *columns), [["grp", f"fe{i}"] for i in large], columns)
        work, rebatch = checkpointed(wide.select(*keys, "grp", *columns)), iter

        def swept(batch):
            return _stacked(batch.select(["grp", *columns]))

    k, y = len(columns), len(columns) - 1
    total = len(groups)

    def products(batch) -> np.ndarray:
        m, _ = swept(batch)
        out = np.zeros((total, k, k))
        for g in np.unique(m[:, 0]).astype(int):
            z = m[m[:, 0] == g, 1:]
            out[g] = z.T @ z
        return out

    gram_of = sum_of_vectors(work, products, total * k * k, rebatch).reshape(total, k, k)
    solved: dict[str, _Solved] = {}
    for name, m in models.items():
        g = group_of[name]
        n = facts[g]["n"]
        scale = np.array([1.0 * n] * len(dummies) + [n * max(facts[g][f"q_{a}"], 1e-300) for a in values[1:]] + [0.0])
        xs = [len(dummies) + values.index(alias[x]) - 1 for x in m.regressors]
        solved[name] = _solve(gram_of[g], g, list(range(len(dummies))), xs, y, scale)

    starts = np.cumsum([0, *[len(s.shown) for s in solved.values()]])
    every = list(solved.values())
    meat = None
    if vcov == "hetero":
        def outer(batch) -> np.ndarray:
            s = _scores(swept(batch)[0], every, y)
            return s.T @ s

        meat = sum_of_vectors(work, outer, int(starts[-1]) ** 2, rebatch).reshape(starts[-1], starts[-1])
    elif vcov in ("cluster", "conley") and starts[-1]:
        sums, names = _score_sums(work, keys, columns, every, rebatch, swept)
        if vcov == "cluster":
            meat = gram(sums, names)[1:, 1:]
        else:
            meat = spatial_meat(sums, names, cutoff_km, *keys, metric=metric, pixel_km=pixel_km)
    elif vcov not in ("iid", "cluster", "conley"):
        raise ValueError(vcov)
    release(work, stack)

    fits = {}
    for i, (name, s) in enumerate(solved.items()):
        g, m = s.group, models[name]
        n = facts[g]["n"]
        levels = {e: sizes[g, j][0] for j, e in enumerate(effects)}
        parameters = (sum(levels.values()) - (len(effects) - 1) if effects else 0) + len(s.shown)
        counted = parameters
        if vcov == "cluster" and not count_nested:
            counted -= sum(sizes[g, j][0] - 1 for j in range(len(effects)) if sizes[g, j][1] == sizes[g, j][0])
        free = max(n - counted, 1)
        degrees = float(free)
        if vcov == "iid":
            covariance = s.bread * (s.rss / free)
        else:
            adjust = (n - 1) / free if small_sample else 1.0
            if vcov == "hetero":
                adjust = n / free if small_sample else 1.0
            elif vcov == "cluster":
                clusters = sizes[g, -1][0]
                degrees = float(max(clusters - 1, 1))
                if small_sample:
                    adjust *= clusters / max(clusters - 1, 1)
            block = slice(starts[i], starts[i + 1])
            covariance = s.bread @ meat[block, block] @ s.bread * adjust if len(s.shown) else np.zeros((0, 0))
        shown = [x_names_at(columns[j], alias) for j in s.shown]
        variance = np.diag(covariance)
        size = n * facts[g]["v"] if facts[g]["v"] else 0.0
        fits[name] = FixedEffectsFit(
            target=target, terms=shown, estimates=s.beta, errors=np.sqrt(np.where(variance > 0, variance, np.nan)),
            dropped=[c for c in m.regressors if c not in shown], n=n, parameters=parameters,
            r2=1.0 - s.rss / size if size else math.nan, within_r2=1.0 - s.rss / s.null_rss if s.null_rss > 0 else math.nan,
            effects=list(effects), vcov=vcov, covariance=covariance, degrees=degrees, levels=levels, rounds=rounds,
        )
    return fits


def x_names_at(column: str, alias: dict[str, str]) -> str:
    return next(name for name, a in alias.items() if a == column)


def fixed_effects_ols(df: DataFrame, target: str, regressors: Sequence[str], effects: Sequence[str], **options) -> FixedEffectsFit:
    """One model; see ``fit_family`` for the options."""
    return fit_family(df, target, {"m": Model(tuple(regressors))}, effects, **options)["m"]
