"""Queries and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """One module's queries by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Adds a function under its own name; ``sql`` is None where SQL can't state the result."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


def cents(column: str) -> Column:
    """Money and rates are doubles of two decimals; decimals add up alike in any order."""
    return F.col(column).cast("decimal(12,2)")


def total(column: Column) -> Column:
    """A sum of cents as a double."""
    return F.sum(column).cast("double")
