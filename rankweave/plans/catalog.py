"""All registered queries over the driver tables."""

from __future__ import annotations

from rankweave.plans import analytics, answers, corpus, retrieval, text
from rankweave.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analytics", "answers", "corpus", "retrieval", "text"]
