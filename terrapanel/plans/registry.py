"""Registry of named queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrapanel.plans.tables import with_tables

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def _rounding(spec: str, digits: int) -> dict[str, int]:
    """``"a b:4"`` to digits per column."""
    out = {}
    for part in spec.split():
        name, _, own = part.partition(":")
        out[name] = int(own) if own else digits
    return out


def query(name: str, sql: str | None = None, rounded: str = "", digits: int = 9) -> Callable[[Plan], Plan]:
    """Register a plan; ``rounded`` names the double columns to round on both sides.

    Floating sums depend on the order of addition, so they are compared after rounding.
    """
    places = _rounding(rounded, digits)
    # adding zero turns -0.0 into 0.0
    cut = {c: f"round(`{c}`, {d}) + 0.0D AS `{c}`" for c, d in places.items()}

    def wrap(plan: Plan) -> Plan:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = plan(spark, sf_dir)
            return out.selectExpr(*[cut.get(c, f"`{c}`") for c in out.columns]) if places else out

        QUERIES[name] = run
        if sql is not None:
            body = with_tables(sql)
            if places:
                replaced = ", ".join(f'round("{c}", {d}) + 0.0 AS "{c}"' for c, d in places.items())
                body = f"SELECT * REPLACE ({replaced}) FROM ({body})"
            ORACLES[name] = body
        return plan

    return wrap
