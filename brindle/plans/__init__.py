"""Queries of the engine: importing this package registers them."""

from . import compare_queries, entity_queries, text_queries  # noqa: F401
