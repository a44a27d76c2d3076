"""All queries outside the corpus operators, and their SQL."""

from __future__ import annotations

from sedge.plans import cases, checks, jobs, registry, runs, sidecars, streams

QUERIES = registry.QUERIES | runs.QUERIES | streams.QUERIES | checks.QUERIES | sidecars.QUERIES | jobs.QUERIES | cases.QUERIES
ORACLE = registry.ORACLE | runs.ORACLE | streams.ORACLE | checks.ORACLE | sidecars.ORACLE | jobs.ORACLE | cases.ORACLE
