"""All queries of the engine with their SQL oracles."""

from __future__ import annotations

from . import binary_queries, queries, relational_queries, streaming_queries  # noqa: F401  they register themselves

QUERIES = dict(queries.QUERIES)
ORACLES = dict(queries.ORACLES)
