"""All registered queries over the test tables, each with its SQL where there is one."""

from __future__ import annotations

from . import answers, corpus, forum, retrieval, streams  # noqa: F401
from .registry import QUERIES, SQL

rrf_hybrid = QUERIES["rrf_hybrid"]
__all__ = ["QUERIES", "SQL", "rrf_hybrid"]
