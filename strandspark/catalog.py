"""All registered queries and their DuckDB oracles, by the operator ids of the survey."""

from __future__ import annotations

from strandspark.plans import agreement_queries, detail_queries, export_queries, interval_queries, loading_queries, pairing_queries, scalar_queries, seed_queries

_MODULES = (seed_queries, interval_queries, scalar_queries, agreement_queries, pairing_queries, export_queries, detail_queries, loading_queries)

QUERIES = {name: query for module in _MODULES for name, (query, _) in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
