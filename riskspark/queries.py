"""Catalogue of queries and of the SQL that checks them."""

from __future__ import annotations

from .plans import cleaning, diag_queries, file_queries, report_queries, risk_queries, study_queries, tail_queries, vol_queries

_PARTS = (cleaning, risk_queries, vol_queries, tail_queries, diag_queries, file_queries, report_queries, study_queries)
QUERIES: dict = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL: dict = {k: v for p in _PARTS for k, v in p.SQL.items()}
