"""All registered queries but those of the llm subpackage."""

from speechlake.plans import corpus_queries, metric_queries, signal_queries, speaker_queries, stream_queries
from speechlake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "corpus_queries", "metric_queries", "signal_queries", "speaker_queries", "stream_queries"]
