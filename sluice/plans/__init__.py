"""Queries over the driver's tables, one per operator."""

from __future__ import annotations

from .catalog import QUERIES, SQL, Query


def _load() -> None:
    from . import benchmark_queries, boards, corpus, dashboards, evidence_queries, snapshots  # noqa: F401


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
