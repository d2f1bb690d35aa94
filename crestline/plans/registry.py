"""All registered queries."""
from . import catalog_queries, feedback_queries, io_queries, series_queries, timeline_queries, window_queries  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
