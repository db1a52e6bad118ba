"""Registered queries of the statistical operators, each with the SQL that the oracle runs."""

from __future__ import annotations

from . import catalogue_queries, detail_queries, full_queries, metadata_queries, place_queries, record_queries, result_queries, rule_queries, run_queries, search_queries, series_queries, source_queries, text_queries, view_queries

MODULES = (run_queries, detail_queries, full_queries, metadata_queries, text_queries, result_queries, rule_queries, series_queries, view_queries, place_queries, catalogue_queries, record_queries, search_queries, source_queries)
QUERIES = {name: f for m in MODULES for name, f in m.REGISTRY.queries.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.REGISTRY.oracles.items()}
