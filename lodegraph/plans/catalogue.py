"""Registered queries over the driver tables, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from lodegraph.plans import activity_queries, check_queries, connector_queries, context_queries, document_queries, graph_queries, history_queries, instant_queries, matching_queries, metric_queries, network_queries, ontology_queries, resolution_queries, retrieval_queries, rule_queries, screening_queries, store_queries, sync_queries, temporal_queries, vector_queries
from lodegraph.plans.registry import ORACLES, QUERIES

FLAGSHIP = "degree_topk"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "activity_queries", "check_queries", "connector_queries", "context_queries", "document_queries", "graph_queries", "history_queries", "instant_queries", "matching_queries", "metric_queries", "network_queries", "ontology_queries", "resolution_queries", "retrieval_queries", "rule_queries", "screening_queries", "store_queries", "sync_queries", "temporal_queries", "vector_queries"]
