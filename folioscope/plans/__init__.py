"""Registered queries and their SQL twins, by area."""

from folioscope.plans.registry import ORACLES, QUERIES
from folioscope.plans import catalog_plans, graph_plans, retrieval_plans, similarity_plans, stream_plans, text_plans  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
