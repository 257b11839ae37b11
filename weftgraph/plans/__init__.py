"""Registered queries over the test tables and the SQL that checks them."""

from weftgraph.plans import flow_queries, path_queries, refinement_queries, spectral_queries, structure_queries
from weftgraph.plans.graph_queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flow_queries", "path_queries", "refinement_queries", "spectral_queries", "structure_queries"]
