"""Importing this module registers every query."""

from terrapanel.plans import (  # noqa: F401
    feature_queries,
    model_queries,
    panel_queries,
    profile_queries,
    ranking_queries,
    regression_queries,
    spatial_queries,
    structure_queries,
)
from terrapanel.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
