"""Registry of the example queries: one per operator, with the equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Parquet tables of one folder by name: ``t.orders`` reads ``orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL if there is one."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def r6(c: Column | str) -> Column:
    """Rounded double, so that both engines print the same number."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def day(c: Column | str) -> Column:
    """Day as text."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


def hash_int(c: Column, digits: int = 7) -> Column:
    return F.conv(F.substring(F.md5(c.cast("string")), 1, digits), 16, 10).cast("long")
