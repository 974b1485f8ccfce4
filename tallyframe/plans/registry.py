"""All queries of the engine by name, and the SQL each is held against."""

from __future__ import annotations

from . import branch_queries, corpus_queries, data_queries, estate_queries, file_queries, program_queries, total_queries

MODULES = (data_queries, estate_queries, corpus_queries, program_queries, total_queries, branch_queries, file_queries)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
