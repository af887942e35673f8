"""Registry of named queries on the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function name; ``sql`` is its twin."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(value: Column | str) -> Column:
    """Six decimals, half up, without negative zero: the same arithmetic in both engines."""
    column = F.col(value) if isinstance(value, str) else value
    return F.floor(column * 1e6 + 0.5) / 1e6


def digest(values: Column) -> Column:
    """One number for all values of an array, in their order: each in millionths, times its place."""
    parts = F.transform(values, lambda v, i: (F.floor(v.cast("double") * 1e6 + 0.5) * (i + 1)).cast("bigint"))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, v: a + v)


def digest_sql(values: str) -> str:
    """``digest`` in SQL."""
    part = f"(floor(({values})[i]::DOUBLE * 1e6 + 0.5) * i)::BIGINT"
    return f"coalesce(list_sum([{part} FOR i IN range(1, len({values}) + 1)]), 0)::BIGINT"


def s6(expression: str) -> str:
    """``r6`` in SQL."""
    return f"floor(({expression}) * 1e6 + 0.5) / 1e6"
