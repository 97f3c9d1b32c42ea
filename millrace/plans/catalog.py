"""All registered queries of the engine and the SQL that says what they return."""

from __future__ import annotations

from millrace.plans import control, exchange, listings, postings, relational, reports, statistics, streams, texts
from millrace.plans.registry import ORACLES, QUERIES

FLAGSHIP = "daily_event_funnel"
MODULES = (statistics, relational, texts, control, reports, postings, listings, exchange, streams)

__all__ = ["FLAGSHIP", "MODULES", "ORACLES", "QUERIES"]
