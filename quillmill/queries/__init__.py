"""The engine's queries and their SQL."""

from __future__ import annotations

from quillmill.queries import analysis, documents, streams, text  # noqa: F401 - they register their queries
from quillmill.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
