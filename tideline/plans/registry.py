"""Queries of the event-analytics operators and the SQL that checks them."""

from tideline.plans import model_queries, quality_queries, rate_queries, scorer_queries, study_queries, trajectory_queries, window_queries

_MODULES = (rate_queries, window_queries, quality_queries, study_queries, model_queries, scorer_queries, trajectory_queries)
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
