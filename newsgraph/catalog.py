"""All registered queries over the given tables, and their SQL twins."""

from __future__ import annotations

from newsgraph.operators import assignment, clusters, documents, entities, events, intel, normalize, normalizers, read, score, search, tables, upserts, vectors  # noqa: F401
from newsgraph.registry import ORACLE, QUERIES
from newsgraph.streaming import ingest, jobs, lifecycle  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
