"""All registered queries; importing the modules registers them."""

from tidelight.plans import admission_queries, bar_queries, evaluation_queries, join_queries, market_queries, model_queries, scalar_queries, sequence_queries, source_queries, span_queries, stat_queries, stream_queries, trading_queries  # noqa: F401
from tidelight.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
