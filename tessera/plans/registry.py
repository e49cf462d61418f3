"""Named queries over the test tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *needs: str, name: str | None = None, extra: dict[str, str] | None = None):
    """Registers a query; ``needs`` are the common table expressions that its SQL uses."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = with_ctes(sql, *needs, extra=extra) if needs or extra else sql
        return f

    return add


def long(c):
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


def r6(c):
    """Six decimals: what both engines agree on after sums in different orders."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
