"""Registry of named queries: what runs on Spark, and the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp without zone, read as UTC."""
    return F.unix_micros(F.to_utc_timestamp(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"), "UTC"))


def hundredths(x: Column | str) -> Column:
    """A double as whole hundredths, cut down; sums of these do not depend on their order."""
    return F.floor((F.col(x) if isinstance(x, str) else x) * 100).cast("long")
