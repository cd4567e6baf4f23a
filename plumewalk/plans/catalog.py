"""Importing this module registers every query."""

from plumewalk.plans import q_aggregate, q_clean, q_geo, q_geostat, q_models, q_series, q_spatial, q_splits, q_stats  # noqa: F401
from plumewalk.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
