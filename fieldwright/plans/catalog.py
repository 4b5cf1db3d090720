"""Every query of the library with its SQL."""

from __future__ import annotations

from fieldwright.plans import documents, labels, reports, review, scoring
from fieldwright.plans.registry import QUERIES, SQL

_MODULES = (documents, labels, reports, review, scoring)


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict:
    return SQL
