"""Registered queries, their SQL counterparts and the daily job."""

from tidemill.plans import (  # noqa: F401  (importing registers the queries)
    aggregating,
    cleaning,
    daily,
    functions,
    joining,
    revenue,
    storing,
    streams,
    timing,
    windowing,
)
from tidemill.plans.registry import QUERIES

__all__ = ["QUERIES"]
