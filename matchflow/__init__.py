"""matchflow: Spark-first sports-event analytics.

Decode topic records into typed tables, keep the latest state per key,
compute match / team / notification statistics, fan events out to the
users interested in them and answer serving queries. Every operator takes
DataFrames and returns a DataFrame; the same functions run on batch tables
and inside Structured Streaming micro-batches.
"""

from matchflow.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
