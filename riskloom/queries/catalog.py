"""All registered queries."""

from __future__ import annotations

from riskloom.queries import aggregations, expressions, features, scoring, storage  # noqa: F401
from riskloom.queries.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
