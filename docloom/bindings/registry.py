"""Registry of named queries over the driver tables and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.bindings.tables import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str = "", sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` may use the derived tables named in ``tables``."""
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(tables, sql) if tables else sql
        return fn
    return add


def us(col: str, name: str | None = None) -> Column:
    return F.unix_micros(col).alias(name or col)


def day(col: str, name: str | None = None) -> Column:
    return F.col(col).cast("string").alias(name or col)


def r6(col: str, name: str | None = None) -> Column:
    return F.round(F.col(col), 6).alias(name or col)
