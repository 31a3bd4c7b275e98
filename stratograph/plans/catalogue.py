"""All queries over the driver's tables and their SQL."""

from __future__ import annotations

from . import debt_queries, graph_queries, import_queries, map_queries, record_queries, resolve_queries, source_queries  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
