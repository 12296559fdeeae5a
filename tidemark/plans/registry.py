"""All registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from tidemark.plans import audits, branches, cases, histories, metrics, relations, scores, shapes, texts
from tidemark.plans._base import QUERIES, SQL, Query

#: The modules whose import registers queries.
MODULES = (relations, histories, metrics, scores, shapes, texts, cases)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
