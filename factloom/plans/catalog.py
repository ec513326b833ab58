"""Registered queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from factloom.plans import analysis, commands, gates, hierarchical, hybrid, jobs, lifecycle, linking, messages, model_output, recall, retrieval, rollout, stores, writes

_PARTS = (retrieval, lifecycle, analysis, writes, linking, commands, recall, gates, messages, hybrid, hierarchical, stores, model_output, rollout, jobs)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
