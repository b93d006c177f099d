"""All registered queries."""

from tidemark.plans import evaluation_queries, frame_queries, market_queries, neighbour_queries, panel_queries, regime_queries
from tidemark.plans.registry import ORACLES, QUERIES

FAMILIES = (panel_queries, evaluation_queries, market_queries, regime_queries, neighbour_queries, frame_queries)

__all__ = ["FAMILIES", "ORACLES", "QUERIES"]
