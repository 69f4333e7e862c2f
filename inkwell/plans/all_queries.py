"""All registered queries, by importing the modules that register them."""

from . import assembly_queries, billing_queries, content_queries, feature_queries, operations_queries, search_queries, shelf_queries, structure_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
