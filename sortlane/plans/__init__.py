"""Queries of the library over the driver's tables."""

from . import lidar_queries, match_queries, more_queries, sequence_queries, sink_queries, store_queries, text_queries  # noqa: F401, I001
from . import stream_queries  # noqa: F401  (after the batch twins, whose SQL it uses)
from .catalog import QUERIES, SQL  # noqa: F401
