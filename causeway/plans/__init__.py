"""Registered queries of the engine."""

from causeway.plans import engine_queries, extra_queries, graph_queries, helper_queries, market_queries, relational_queries, rule_queries, state_queries, text_queries
from causeway.plans.registry import ORACLES, QUERIES, register

__all__ = ["ORACLES", "QUERIES", "flagship", "register"]


def flagship(spark, sf_dir):
    """Which direction, magnitude and confidence each asset and window gets."""
    return graph_queries.p03(spark, sf_dir)


_ = (engine_queries, extra_queries, helper_queries, market_queries, relational_queries, rule_queries, state_queries, text_queries)
