"""All queries of the engine."""

from .registry import QUERIES, SQL
from . import belief_queries, counting_queries, history_queries, model_queries, moment_queries, raster_queries, record_queries, relational_queries, sampling_queries, scoring_queries, streaming_queries, temporal_queries, text_queries  # noqa: F401

__all__ = ["QUERIES", "SQL"]
