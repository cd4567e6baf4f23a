"""Query catalogue: each entry pairs a DataFrame plan with the SQL it must agree with."""

from plumewalk.plans.registry import REGISTRY, query

__all__ = ["REGISTRY", "query"]
