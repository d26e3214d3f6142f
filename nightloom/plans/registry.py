"""All queries of the site-and-night operators, by name."""

from __future__ import annotations

from nightloom.plans import check_queries, fetch_queries, funnel, report_queries, sky_queries, space_queries, text_queries, time_queries, upkeep_queries
from nightloom.streaming import windows

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for part in (time_queries, space_queries, report_queries, text_queries, check_queries, upkeep_queries, funnel, sky_queries, fetch_queries, windows):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.SQL

FLAGSHIP = time_queries.longest_clear_window
