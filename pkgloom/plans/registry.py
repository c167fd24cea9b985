"""A table of named queries, each with its SQL equivalent where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgloom.sources.catalog import Catalog, VIEWS_SQL


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        """Registers f(catalog) under ``name``; ``sql`` may use the derived tables of VIEWS_SQL."""

        def add(f: Callable[[Catalog], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
            if sql is not None:
                body = sql.strip()
                rest = body[4:].strip() if body[:5].lower() == "with " else None
                self.sql[name] = f"WITH {'RECURSIVE ' * ('recursive' in body[:16].lower())}{VIEWS_SQL}, {rest.removeprefix('RECURSIVE ').removeprefix('recursive ')}" if rest else f"WITH {VIEWS_SQL} {body}"
            return f

        return add


def micros(c: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c) if isinstance(c, str) else c)
