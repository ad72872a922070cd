"""Collects the queries and oracle SQL of all plan modules."""

from __future__ import annotations

from .plans import checks, derived, extras, hosts, pages, records, stores, streams, tables, urls

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (urls, pages, tables, extras, checks, records, streams, hosts, derived, stores):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
