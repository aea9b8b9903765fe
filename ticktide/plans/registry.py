"""Every operator as a query over the given tables, with the SQL that checks it.

A query returns plain columns: dates as text, flags as 0/1, vectors as text of whole
millionths, real numbers rounded, so that any engine's rows compare cell by cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktide.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``, with the SQL that must give the same rows."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: plain(fn(Tables(spark, folder)))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return c.cast("string").alias(f.name)
        if isinstance(f.dataType, T.BooleanType):
            return c.cast("int").alias(f.name)
        return c

    return df.select(*[cell(f) for f in df.schema.fields])


def pack(vec: Column | str) -> Column:
    whole = F.transform(vec, lambda x: F.round(x * 1e6).cast("bigint").cast("string"))
    return F.array_join(whole, ",")


def r(c: Column | str, digits: int = 6) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    name = c if isinstance(c, str) else None
    out = F.round(column, digits)
    return out.alias(name) if name else out
