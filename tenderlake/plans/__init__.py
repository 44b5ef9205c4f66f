"""Registered queries: importing this package registers all of them."""

from . import classify_queries, extract_queries, lifecycle_queries, relational_queries, scalar_queries, source_queries  # noqa: F401
