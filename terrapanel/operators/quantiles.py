"""Exact order statistics without gathering a column in one place.

Spark's ``percentile`` keeps every distinct value of a group in one task. Here a
mergeable sketch brackets each wanted rank, a counting pass proves the bracket, and
only a bracket of bounded size is ever gathered. Every pass is one map-side combined
aggregation that returns a single row, so neither ties nor hot keys matter and the
answer is exact whatever the sketch said.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.session import checkpointed

#: Values of one bracket, and of all brackets of one job, that a task may gather.
GATHER_LIMIT = 200_000
GATHER_TOTAL = 4_000_000
SKETCH_ACCURACY = 10_000


@dataclass
class _Target:
    column: str
    rank: int
    n: int
    low: float | None = None  # exclusive
    high: float | None = None  # exclusive
    below: int = 0  # values <= low
    size: int = 0  # values strictly inside
    value: float | None = None
    cuts: tuple[float, ...] = ()

    @property
    def done(self) -> bool:
        return self.value is not None


def _value(column: str) -> Column:
    v = F.col(column).cast("double")
    return F.when(~F.isnan(v), v)


def _inside(t: _Target) -> Column:
    v = _value(t.column)
    cond = v.isNotNull()
    if t.low is not None:
        cond = cond & (v > F.lit(t.low))
    if t.high is not None:
        cond = cond & (v < F.lit(t.high))
    return F.when(cond, v)


def first_row_of(df: DataFrame, aggs: list[Column]) -> list:
    """Run many aggregates as one job; wide lists are split to keep plans small."""
    out: list = []
    for i in range(0, len(aggs), 200):
        out.extend(df.agg(*[a.alias(f"a{j}") for j, a in enumerate(aggs[i : i + 200])]).first())
    return out


def _bounded(items: list, sizes: list[int], most: int = 0) -> list[list]:
    """Consecutive items whose sizes add up to ``most`` (by default ``GATHER_TOTAL``) or stand alone."""
    out: list[list] = []
    total = 0
    for item, size in zip(items, sizes):
        if not out or total + size > (most or GATHER_TOTAL):
            out.append([])
            total = 0
        out[-1].append(item)
        total += size
    return out


def _solve(df: DataFrame, targets: list[_Target], limit: int) -> None:
    while True:
        active = [t for t in targets if not t.done]
        if not active:
            return
        small = [t for t in active if t.size <= limit]
        if small:
            intervals = sorted({(t.column, t.low, t.high) for t in small}, key=str)
            lookup = {key: [t for t in small if (t.column, t.low, t.high) == key] for key in intervals}
            for some in _bounded(intervals, [lookup[key][0].size for key in intervals]):
                aggs = []
                for key in some:
                    group = lookup[key]
                    ordered = F.sort_array(F.collect_list(_inside(group[0])))
                    aggs.append(F.array(*[F.get(ordered, F.lit(t.rank - t.below)) for t in group]))
                for key, values in zip(some, first_row_of(df, aggs)):
                    for t, v in zip(lookup[key], values):
                        t.value = v
        large = [t for t in active if t.size > limit]
        if large:
            margin = 2.0 / SKETCH_ACCURACY
            aggs = []
            for t in large:
                p = (t.rank - t.below) / max(t.size - 1, 1)
                ps = [min(max(p + d, 0.0), 1.0) for d in (-margin, margin)]
                aggs.append(F.percentile_approx(_inside(t), ps, SKETCH_ACCURACY))
            for t, cuts in zip(large, first_row_of(df, aggs)):
                t.cuts = tuple(sorted(set(cuts)))
            aggs = []
            for t in large:
                for c in t.cuts:
                    aggs += [F.count_if(_value(t.column) < F.lit(c)), F.count_if(_value(t.column) <= F.lit(c))]
            counts = iter(first_row_of(df, aggs))
            for t in large:
                _narrow(t, [(c, next(counts), next(counts)) for c in t.cuts])


def _narrow(t: _Target, proven: list[tuple[float, int, int]]) -> None:
    low, below, high, end = t.low, t.below, t.high, t.below + t.size
    for cut, less, upto in proven:
        if less <= t.rank < upto:
            t.value = cut
            return
        if t.rank >= upto:
            low, below = cut, upto
        elif end > less:
            high, end = cut, less
            break
    t.low, t.below, t.high, t.size = low, below, high, end - below


def order_statistics(
    df: DataFrame, ranks: dict[str, Sequence[int]], counts: dict[str, int] | None = None, limit: int = GATHER_LIMIT
) -> dict[str, dict[int, float]]:
    """Exact values at 0-based ascending ranks, nulls and NaN left out.

    Integers must be below 2**53 in size, as values are compared as doubles.
    """
    if counts is None:
        counts = count_values(df, list(ranks))
    targets = [
        _Target(c, r, counts[c], size=counts[c]) for c, rs in ranks.items() for r in sorted(set(rs)) if 0 <= r < counts[c]
    ]
    _solve(df, targets, limit)
    out: dict[str, dict[int, float]] = {c: {} for c in ranks}
    for t in targets:
        out[t.column][t.rank] = t.value
    return out


def count_values(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    return dict(zip(columns, first_row_of(df, [F.count(_value(c)) for c in columns])))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], limit: int = GATHER_LIMIT
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column; ``None`` where a column has no value."""
    counts = count_values(df, columns)
    ranks = {}
    for c in columns:
        positions = [p * (counts[c] - 1) for p in probs] if counts[c] else []
        ranks[c] = sorted({r for x in positions for r in (math.floor(x), math.ceil(x))})
    found = order_statistics(df, ranks, counts, limit)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        row: list[float | None] = []
        for p in probs:
            if not counts[c]:
                row.append(None)
                continue
            x = p * (counts[c] - 1)
            a, b = found[c][math.floor(x)], found[c][math.ceil(x)]
            row.append(a + (b - a) * (x - math.floor(x)))
        out[c] = row
    return out


#: Values of a bracket gathered for one group, and columns handled in one set of passes.
GROUP_LIMIT = 4096
GROUP_COLUMNS = 8
#: Equal steps of the sketch that narrows a bracket still too large.
GRID = 128


def _match(keys: Sequence[str], tag: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"l.`{k}`").eqNullSafe(F.col(f"{tag}.`{k}`"))
    return cond


def beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on keys that may be null; the columns of ``left`` and those of ``right`` beyond the keys."""
    more = [c for c in right.columns if c not in keys]
    joined = left.alias("l").join(right.alias("r"), _match(keys, "r"), "left")
    return joined.select(*[F.col(f"l.`{c}`").alias(c) for c in left.columns], *[F.col(f"r.`{c}`").alias(c) for c in more])


def _ranks(n: Column, probs: Sequence[float]) -> Column:
    """0-based ranks below and above each wanted position."""
    at = [F.lit(float(p)) * (n - 1) for p in probs]
    return F.array(*[f(x).cast("bigint") for x in at for f in (F.floor, F.ceil)])


def _narrowed(c: int) -> Column:
    """The bracket of every rank of column ``c`` after counting at its cuts, or its value where a cut has that rank."""
    counted = F.arrays_zip(F.col(f"cuts{c}").alias("cut"), F.col(f"less{c}").alias("less"), F.col(f"upto{c}").alias("upto"))

    def one(t: Column) -> Column:
        r = t["rank"]
        hit = F.filter(counted, lambda k: (k["less"] <= r) & (r < k["upto"]))
        under = F.filter(counted, lambda k: k["upto"] <= r)
        over = F.filter(counted, lambda k: k["less"] > r)
        low = F.array_max(F.transform(under, lambda k: F.struct(k["upto"].alias("n"), k["cut"].alias("v"))))
        high = F.array_min(F.transform(over, lambda k: F.struct(k["less"].alias("n"), k["cut"].alias("v"))))
        # Cuts are chosen inside the bracket, but one at its edge must not widen it again.
        below = F.greatest(t["below"], F.coalesce(low["n"], F.lit(0)))
        end = F.least(t["below"] + t["size"], F.coalesce(high["n"], t["below"] + t["size"]))
        return F.struct(
            r.alias("rank"), F.when(low["n"] >= t["below"], low["v"]).otherwise(t["low"]).alias("low"),
            F.when(high["n"] <= t["below"] + t["size"], high["v"]).otherwise(t["high"]).alias("high"), below.alias("below"),
            (end - below).alias("size"), F.coalesce(t["value"], F.get(hit, F.lit(0))["cut"]).alias("value"),
        )

    return F.transform(F.col(f"t{c}"), one)


def _within(v: Column, t: Column) -> Column:
    open_low, open_high = t["low"].isNull() | (v > t["low"]), t["high"].isNull() | (v < t["high"])
    return F.when(t["value"].isNull() & open_low & open_high, v)


def exact_quantiles_by(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float], limit: int = GROUP_LIMIT
) -> DataFrame:
    """Quantile arrays per group: keys + one ``array<double>`` column per measure, null without values.

    All groups go through the same passes together, whatever their number and sizes: a sketch per
    group brackets its ranks, a grouped count proves the brackets, and the values inside them, at
    most ``limit`` for each rank, are gathered per group. While any bracket is larger, a sketch
    inside it narrows it first. Every pass combines before it shuffles, and the driver sees one
    number a round.
    """
    keys, columns = list(keys), list(columns)
    if len(columns) > GROUP_COLUMNS:
        head = exact_quantiles_by(df, keys, columns[:GROUP_COLUMNS], probs, limit)
        return beside(head, exact_quantiles_by(df, keys, columns[GROUP_COLUMNS:], probs, limit), keys)
    ks, ts = range(len(columns)), range(2 * len(probs))
    clean = df.select(*keys, *[_value(c).alias(f"v{i}") for i, c in enumerate(columns)])
    margin = 2.0 / SKETCH_ACCURACY
    near = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-margin, 0.0, margin)})
    state = clean.groupBy(*keys).agg(
        *[F.count(f"v{c}").alias(f"n{c}") for c in ks],
        *[F.coalesce(F.percentile_approx(f"v{c}", near, SKETCH_ACCURACY), F.array().cast("array<double>")).alias(f"cuts{c}") for c in ks],
    )
    none = F.lit(None).cast("double")
    start = lambda c: F.transform(
        _ranks(F.col(f"n{c}"), probs),
        lambda r: F.struct(
            r.alias("rank"), none.alias("low"), none.alias("high"), F.lit(0).cast("bigint").alias("below"),
            F.col(f"n{c}").alias("size"), none.alias("value"),
        ),
    )
    state = state.withColumns({f"t{c}": start(c) for c in ks} | {f"cuts{c}": F.array_sort(F.array_distinct(f"cuts{c}")) for c in ks})
    cuts = len(near)
    while True:
        state = checkpointed(state)
        rows = beside(clean, state.select(*keys, *[f"cuts{c}" for c in ks]), keys)
        at = lambda c, j: F.get(F.col(f"cuts{c}"), F.lit(j))
        sums = {}
        for c in ks:
            for name, holds in (("less", lambda v, x: v < x), ("upto", lambda v, x: v <= x)):
                sums[f"{name}{c}"] = F.array(*[F.count_if(holds(F.col(f"v{c}"), at(c, j))) for j in range(cuts)])
        counts = rows.groupBy(*keys).agg(*[a.alias(n) for n, a in sums.items()])
        counted = beside(state, counts, keys)
        trimmed = {f"{n}{c}": F.slice(f"{n}{c}", F.lit(1), F.size(f"cuts{c}")) for c in ks for n in ("less", "upto")}
        state = checkpointed(counted.withColumns(trimmed).select(*keys, *[f"n{c}" for c in ks], *[_narrowed(c).alias(f"t{c}") for c in ks]))
        largest = F.greatest(F.lit(0), *[F.max(F.array_max(F.transform(f"t{c}", lambda t: F.when(t["value"].isNull(), t["size"])))) for c in ks])
        if (state.agg(largest).first()[0] or 0) <= limit:
            break
        rows = beside(clean, state.select(*keys, *[f"t{c}" for c in ks]), keys)
        grid = [i / GRID for i in range(GRID + 1)]
        inner = rows.groupBy(*keys).agg(*[
            F.percentile_approx(_within(F.col(f"v{c}"), F.col(f"t{c}")[t]), grid, 8 * GRID).alias(f"g{c}_{t}") for c in ks for t in ts
        ])

        def chosen(c: int) -> Column:
            """Steps of the sketch on either side of each rank's place in its bracket."""
            found = []
            for t in ts:
                place = F.floor((F.col(f"t{c}")[t]["rank"] - F.col(f"t{c}")[t]["below"]) / F.greatest(F.col(f"t{c}")[t]["size"], F.lit(1)) * GRID)
                found += [F.get(F.col(f"g{c}_{t}"), F.greatest(F.lit(0), F.least(F.lit(GRID), (place + d).cast("int")))) for d in (-1, 0, 1, 2)]
            return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))

        cuts = 4 * len(ts)
        state = beside(state, inner, keys).withColumns({f"cuts{c}": chosen(c) for c in ks})
        state = state.select(*keys, *[f"n{c}" for c in ks], *[f"t{c}" for c in ks], *[f"cuts{c}" for c in ks])
    rows = beside(clean, state.select(*keys, *[f"t{c}" for c in ks]), keys)
    held = rows.groupBy(*keys).agg(*[
        F.sort_array(F.collect_list(_within(F.col(f"v{c}"), F.col(f"t{c}")[t]))).alias(f"h{c}_{t}") for c in ks for t in ts
    ])
    both = beside(state, held, keys)

    def result(c: int) -> Column:
        def value(t: int) -> Column:
            target = F.col(f"t{c}")[t]
            return F.coalesce(target["value"], F.get(F.col(f"h{c}_{t}"), (target["rank"] - target["below"]).cast("int")))

        parts = []
        for j, p in enumerate(probs):
            x = F.lit(float(p)) * (F.col(f"n{c}") - 1)
            a, b = value(2 * j), value(2 * j + 1)
            parts.append(a + (b - a) * (x - F.floor(x)))
        return F.when(F.col(f"n{c}") > 0, F.array(*parts))

    return both.select(*keys, *[result(i).alias(c) for i, c in enumerate(columns)])


def mode_value(df: DataFrame, column: str):
    """Most frequent value, the smallest one on ties; ``None`` if there is no value."""
    row = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(column))
        .limit(1)
        .first()
    )
    return None if row is None else row[0]


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value as text, n): the most frequent value of each column, the smallest one on ties.

    Values are counted per column with partial sums before the shuffle; columns without values have no row.
    """
    out = None
    for c in columns:
        counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        best = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("b")).filter("b IS NOT NULL")
        part = best.select(F.lit(c).alias("column_name"), F.col("b.v").cast("string").alias("value"), (-F.col("b.n")).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out
