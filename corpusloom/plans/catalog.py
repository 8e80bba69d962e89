"""All registered queries."""

from corpusloom.plans import change_queries, node_queries, set_queries, source_queries
from corpusloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "change_queries", "node_queries", "set_queries", "source_queries"]
