"""Every operator as a query over the standard tables, most with an equivalent SQL text."""

from __future__ import annotations

from tallygrid.catalog import evaluation, flows, learning, relational, scalars, statistics, summaries
from tallygrid.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluation", "flows", "learning", "relational", "scalars", "statistics", "summaries"]
