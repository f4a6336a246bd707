"""All queries of the library and their SQL twins."""

from __future__ import annotations

from tessera.plans import audit, charts, checks, facts, ops, reports, routing, sources, streams, text, tracing, whole

QUERIES = ops.QUERIES | text.QUERIES | charts.QUERIES | audit.QUERIES | facts.QUERIES | reports.QUERIES | sources.QUERIES | streams.QUERIES | checks.QUERIES | routing.QUERIES | tracing.QUERIES | whole.QUERIES
ORACLES = ops.ORACLES | text.ORACLES | charts.ORACLES | audit.ORACLES | facts.ORACLES | reports.ORACLES | sources.ORACLES | streams.ORACLES | checks.ORACLES | routing.ORACLES | tracing.ORACLES | whole.ORACLES
