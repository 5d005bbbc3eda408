"""Named bins and the expressions that label or count values by them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bin:
    """Half-open interval ``[low, high)``; the last bin of a list may be open above."""

    name: str
    low: float
    high: float
    label: str = ""


# Names and edges must equal the established bin definitions.
TEMPERATURE_BINS = (
    Bin("bin_below_neg10", -50, -10, "Below -10°C"),
    Bin("bin_neg10_neg5", -10, -5, "-10 to -5°C"),
    Bin("bin_neg5_0", -5, 0, "-5 to 0°C"),
    Bin("bin_0_5", 0, 5, "0 to 5°C"),
    Bin("bin_5_10", 5, 10, "5 to 10°C"),
    Bin("bin_10_15", 10, 15, "10 to 15°C"),
    Bin("bin_15_20", 15, 20, "15 to 20°C"),
    Bin("bin_20_25", 20, 25, "20 to 25°C (reference)"),
    Bin("bin_25_30", 25, 30, "25 to 30°C"),
    Bin("bin_30_35", 30, 35, "30 to 35°C"),
    Bin("bin_35_40", 35, 40, "35 to 40°C"),
    Bin("bin_40_plus", 40, 50, "40°C+"),
)
HUMIDITY_BINS = (
    Bin("RH_low", 0, 40, "Low humidity (<40%)"),
    Bin("RH_mid", 40, 70, "Moderate humidity (40-70%)"),
    Bin("RH_high", 70, 100, "High humidity (>70%)"),
)
HUMIDITY_BINS_PLAIN = (
    Bin("dry", 0, 40, "Dry (<40%)"),
    Bin("moderate", 40, 70, "Moderate (40-70%)"),
    Bin("humid", 70, 100, "Humid (>70%)"),
)
PRECIPITATION_BINS_DAILY = (
    Bin("rain_days_0_1mm", 0, 1, "Dry days (≤1mm)"),
    Bin("rain_days_1_10mm", 1, 10, "Light rain (1-10mm)"),
    Bin("rain_days_10_plus", 10, 1000, "Heavy rain (>10mm)"),
)
PRECIPITATION_BINS_MONTHLY = (
    Bin("dry", 0, 25, "Dry (<25mm)"),
    Bin("light", 25, 75, "Light (25-75mm)"),
    Bin("moderate", 75, 150, "Moderate (75-150mm)"),
    Bin("heavy", 150, 1000, "Heavy (>150mm)"),
)
CANOPY_BREAKS = ((0.1, "low_canopy"), (0.3, "medium_canopy"))
CANOPY_LEVELS = ("no_canopy", "low_canopy", "medium_canopy", "high_canopy")
CANOPY_BINS_WIDE = (
    Bin("very_low_canopy", float("-inf"), 0.1),
    Bin("low_canopy", 0.1, 0.3),
    Bin("medium_canopy", 0.3, 0.6),
    Bin("high_canopy", 0.6, float("inf")),
)


def _inside(value: Column, b: Bin, open_top: bool) -> Column:
    cond = value >= F.lit(float(b.low)) if b.low != float("-inf") else value.isNotNull()
    if not open_top:
        cond = cond & (value < F.lit(float(b.high)))
    return cond


def bin_label(value: Column, bins: Sequence[Bin], default: str = "unknown", open_top: bool = True) -> Column:
    """Name of the first bin holding ``value``; NULL and out-of-range give ``default``."""
    out = None
    for i, b in enumerate(bins):
        cond = _inside(value, b, open_top and i == len(bins) - 1)
        out = F.when(cond, b.name) if out is None else out.when(cond, b.name)
    return out.otherwise(default)


def bin_counts(value: Column, bins: Sequence[Bin], prefix: str = "days_in_", open_top: bool = True) -> list[Column]:
    """One conditional count per bin, to be used in a single ``agg``."""
    return [
        F.count_if(_inside(value, b, open_top and i == len(bins) - 1)).alias(f"{prefix}{b.name}")
        for i, b in enumerate(bins)
    ]


def zero_then_breaks(
    value: Column,
    zero: str,
    breaks: Sequence[tuple[float, str]],
    above: str,
    default: str = "unknown",
) -> Column:
    """Exact zero, then right-closed breaks, then everything above the last one."""
    out = F.when(value == 0, zero)
    low = 0.0
    for high, name in breaks:
        out = out.when((value > F.lit(low)) & (value <= F.lit(high)), name)
        low = high
    return out.when(value > F.lit(low), above).otherwise(default)


def quantile_label(
    value: Column, cuts: Sequence[float], labels: Sequence[str], default: str | None = "unknown"
) -> Column:
    """Right-closed intervals between ``cuts``: ``<=c1``, ``(c1,c2]``, ..., ``>ck``."""
    out = F.when(value <= F.lit(cuts[0]), labels[0])
    for low, high, name in zip(cuts, cuts[1:], labels[1:]):
        out = out.when((value > F.lit(low)) & (value <= F.lit(high)), name)
    out = out.when(value > F.lit(cuts[-1]), labels[-1])
    return out.otherwise(default) if default is not None else out
