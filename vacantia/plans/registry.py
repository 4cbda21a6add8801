"""All registered queries on the given tables, with their SQL."""

from __future__ import annotations

from vacantia.plans import derived_queries, page_queries, postings_queries, result_queries, state_queries, stream_queries, varied_queries

_PARTS = (postings_queries, state_queries, page_queries, result_queries, derived_queries, stream_queries, varied_queries)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL = {k: s for part in _PARTS for k, s in part.ORACLE_SQL.items()}
