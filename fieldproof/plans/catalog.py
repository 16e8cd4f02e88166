"""Every registered query with the SQL that must give the same rows.

A query reads the driver tables through ``tables``; its SQL reads the same
tables through ``oracle_views``. ``covers`` names the inventory entries.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldproof.plans.oracle_views import with_views

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    covers: str
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def register(fn: Query) -> Query:
        REGISTRY[fn.__name__] = Entry(fn.__name__, covers, fn, with_views(sql.strip()) if sql else None)
        return fn

    return register


def scaled(x, digits: int):
    """A measured double as a whole number of its last kept digit."""
    return F.round(x * F.lit(float(10 ** digits))).cast("bigint")


def scaled_sql(x: str, digits: int) -> str:
    return f"round(({x}) * {10 ** digits}::DOUBLE)::BIGINT"


@functools.cache
def entries() -> dict[str, Entry]:
    """All entries; importing the query modules fills the registry."""
    from fieldproof.plans import (  # noqa: F401
        chain_queries, coverage_queries, evaluation_queries, identity_queries, live_queries, place_queries,
        report_queries, source_queries, text_queries,
    )

    return REGISTRY
