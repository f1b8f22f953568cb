"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from marginalia.plans import campaign_queries, legal_queries, retrieval_queries, table_queries, text_queries

FLAGSHIP = "r3_bm25_recall"
MODULES = [text_queries, legal_queries, retrieval_queries, table_queries, campaign_queries]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
