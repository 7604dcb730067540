"""Queries by name, each with its SQL counterpart where SQL can state it fairly."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemill.session import apply_settings

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Runner
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a function under ``name``; it runs with this toolkit's settings."""

    def register(fn: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"duplicate query: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(apply_settings(spark), sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = Query(run, sql)
        return fn

    return register
