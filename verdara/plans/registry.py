"""Queries of the analytics part, by name, with their DuckDB counterparts."""

from __future__ import annotations

from verdara.plans import answers, certification, evaluation, evidence, facts, records, retrieval, streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for part in (retrieval, facts, evaluation, certification, evidence, records, answers, streams):
    QUERIES.update(part.QUERIES)
    ORACLES.update(part.ORACLES)
