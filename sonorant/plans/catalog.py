"""Imports every query module, so that all queries are registered."""

from . import aggregate_queries, filter_queries, join_queries, model_queries, scalar_queries, sequence_queries, source_queries, stream_queries  # noqa: F401
