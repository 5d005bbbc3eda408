"""Scalar column expressions over measures, keys, times and coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.DoubleType, T.FloatType)
NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)


# --- schema-driven column lookup -------------------------------------------------


def columns_of(df: DataFrame, kinds: tuple = NUMERIC) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def columns_matching(
    df: DataFrame, *, prefix: str = "", contains: Iterable[str] = (), without: Iterable[str] = ()
) -> list[str]:
    """Columns by name pattern, in table order."""
    wanted, unwanted = tuple(contains), tuple(without)
    return [
        c
        for c in df.columns
        if c.startswith(prefix)
        and (not wanted or any(w in c for w in wanted))
        and not any(u in c for u in unwanted)
    ]


# --- missing values --------------------------------------------------------------


def present(df: DataFrame, column: str) -> Column:
    """Whether a value is there: neither null nor NaN."""
    there = F.col(column).isNotNull()
    return there & ~F.isnan(column) if dict(df.dtypes)[column] in ("double", "float") else there


def nan_to_null(df: DataFrame, sentinels: dict[str, float] | None = None) -> DataFrame:
    """Map NaN, and a per-column nodata value, to NULL so aggregates skip them."""
    sentinels = sentinels or {}
    floating = set(columns_of(df, FLOATING))
    out = []
    for name in df.columns:
        col = F.col(name)
        if name in floating:
            col = F.when(~F.isnan(col), col)
        if name in sentinels:
            col = F.when(col != F.lit(sentinels[name]), col)
        out.append(col.alias(name))
    return df.select(*out)


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with a value in every column, NaN counting as none.

    One condition per column. ``dropna`` puts all columns into a single condition, and the
    optimizer then tries every combination of their aliases: 2**k plans for k columns.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cond = F.lit(True)
    for c in columns if columns is not None else df.columns:
        col = F.col(f"`{c}`")
        cond = cond & col.isNotNull()
        if isinstance(types[c], FLOATING):
            cond = cond & ~F.isnan(col)
    return df.filter(cond)


def infinity_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns) if columns is not None else columns_of(df, FLOATING)
    return df.withColumns({c: F.when(F.abs(F.col(c)) != float("inf"), F.col(c)) for c in names})


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strings to doubles; text that is not a number becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


# --- keys, labels and time -------------------------------------------------------


def grid_key(row: Column, col: Column) -> Column:
    return F.concat_ws("_", row.cast("string"), col.cast("string"))


def month_label(year: str = "year", month: str = "month") -> Column:
    return F.format_string("%d_%02d", F.col(year), F.col(month))


def compact_month_label(year: str = "year", month: str = "month") -> Column:
    return F.format_string("%d%02d", F.col(year), F.col(month))


def joined_label(*names: str, sep: str = "_") -> Column:
    """Concatenation that is NULL as soon as one part is NULL."""
    parts: list[Column] = []
    for i, name in enumerate(names):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.col(name).cast("string"))
    return F.concat(*parts)


def season_of(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .when(month.isin(9, 10, 11), "autumn")
    )


def month_flag(month: Column, months: Sequence[int]) -> Column:
    return month.isin(*months).cast("int")


def cyclic_month(month: Column) -> tuple[Column, Column]:
    angle = month * F.lit(2.0 * math.pi / 12.0)
    return F.sin(angle), F.cos(angle)


def kelvin_to_celsius(kelvin: Column) -> Column:
    return kelvin - F.lit(273.15)


def shift_hours(ts: Column, hours: int) -> Column:
    return ts + F.expr(f"INTERVAL {int(hours)} HOURS")


def hours_in_year(year: Column) -> Column:
    """8784 in leap years, 8760 otherwise."""
    first, nxt = F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year + 1, F.lit(1), F.lit(1))
    return F.datediff(nxt, first) * F.lit(24)


def literal_map(col: Column, mapping: dict, default: Column | None = None) -> Column:
    """Recode by a small literal mapping; unmapped values take ``default`` or NULL."""
    out = None
    for key, value in mapping.items():
        out = F.when(col == F.lit(key), F.lit(value)) if out is None else out.when(col == F.lit(key), F.lit(value))
    if out is None:
        return default if default is not None else F.lit(None)
    return out.otherwise(default) if default is not None else out


# --- families of columns ---------------------------------------------------------


def row_sum(columns: Sequence[str]) -> Column:
    """Sum across a row, missing entries counting as nothing."""
    return reduce(add, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])


def row_entropy(columns: Sequence[str], total: Column, floor: float = 1e-6) -> Column:
    """-sum(s ln s) of shares of ``total``; zero shares count as ``floor``."""

    def term(name: str) -> Column:
        share = F.col(name).cast("double") / (total + F.lit(floor))
        share = F.when(share == 0, F.lit(floor)).otherwise(share)
        return F.coalesce(share * F.log(share), F.lit(0.0))

    return -reduce(add, [term(c) for c in columns])


def products_with(columns: Sequence[str], factor: str, suffix: str) -> dict[str, Column]:
    return {f"{c}{suffix}": F.expr(f"`{c}` * `{factor}`") for c in columns}


# --- coordinates -----------------------------------------------------------------

EARTH_RADIUS_KM = 6371.0088
KM_PER_DEGREE = 111.0


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) ** 2
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def pixel_center(row: Column, col: Column, x0: Column, y0: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Map coordinates of the middle of a raster cell; ``dy`` is negative for north-up."""
    return x0 + (col + 0.5) * dx, y0 + (row + 0.5) * dy


@dataclass(frozen=True)
class AlbersProjection:
    """Ellipsoidal equal-area conic; defaults are WGS84 with two standard parallels."""

    lat_1: float = 25.0
    lat_2: float = 47.0
    lat_0: float = 0.0
    lon_0: float = 105.0
    semi_major: float = 6378137.0
    inverse_flattening: float = 298.257223563
    false_easting: float = 0.0
    false_northing: float = 0.0

    def _shape(self) -> tuple[float, float, float, float, float]:
        f = 1.0 / self.inverse_flattening
        e2 = f * (2.0 - f)
        e = math.sqrt(e2)

        def q(phi: float) -> float:
            s = math.sin(phi)
            return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

        def m(phi: float) -> float:
            s = math.sin(phi)
            return math.cos(phi) / math.sqrt(1 - e2 * s * s)

        p1, p2, p0 = (math.radians(v) for v in (self.lat_1, self.lat_2, self.lat_0))
        n = math.sin(p1) if p1 == p2 else (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
        c = m(p1) ** 2 + n * q(p1)
        rho0 = self.semi_major * math.sqrt(c - n * q(p0)) / n
        return e, e2, n, c, rho0

    def to_lonlat(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Inverse projection as column arithmetic."""
        e, e2, n, c, rho0 = self._shape()
        px = x - F.lit(self.false_easting)
        py = F.lit(rho0) - (y - F.lit(self.false_northing))
        sign = 1.0 if n >= 0 else -1.0
        theta = F.atan2(px * sign, py * sign)
        rho2 = px * px + py * py
        q = (F.lit(c) - rho2 * F.lit((n / self.semi_major) ** 2)) / F.lit(n)
        # Latitude as a series in the authalic latitude: no iteration nested in the
        # expression tree, so the plan stays small. Error is a few millimetres at most.
        qp = (1 - e2) * (1 / (1 - e2) - math.log((1 - e) / (1 + e)) / (2 * e))
        beta = F.asin(F.greatest(F.least(q / F.lit(qp), F.lit(1.0)), F.lit(-1.0)))
        a2 = e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040
        a4 = 23 * e2**2 / 360 + 251 * e2**3 / 3780
        a6 = 761 * e2**3 / 45360
        phi = beta + a2 * F.sin(2 * beta) + a4 * F.sin(4 * beta) + a6 * F.sin(6 * beta)
        lon = F.lit(self.lon_0) + F.degrees(theta / F.lit(n))
        return lon, F.degrees(phi)

    def forward(self, lon: float, lat: float) -> tuple[float, float]:
        """Driver-side forward projection of one point, for setting up tests."""
        e, e2, n, c, rho0 = self._shape()
        s = math.sin(math.radians(lat))
        q = (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
        rho = self.semi_major * math.sqrt(c - n * q) / n
        theta = n * math.radians(lon - self.lon_0)
        return self.false_easting + rho * math.sin(theta), self.false_northing + rho0 - rho * math.cos(theta)
