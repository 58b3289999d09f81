"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, TimestampType

from rigpulse.session import ship_package, use_local_folder, use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, times without zone, so that both engines print the same values."""
    columns = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DoubleType):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(field.dataType, ArrayType) and isinstance(field.dataType.elementType, DoubleType):
            c = F.transform(c, lambda x: F.round(x, digits) + F.lit(0.0))
        elif isinstance(field.dataType, TimestampType):
            c = c.cast("timestamp_ntz")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(sql: str | None = None, doubles: list[str] | str = (), digits: int = 6):
    """Register a query under its function's name; ``doubles`` are the columns to round in the SQL."""
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        key = fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            use_local_folder(spark)
            ship_package(spark)
            return tidy(fn(spark, sf_dir), digits)

        QUERIES[key] = run
        if sql is not None:
            wanted = doubles.split() if isinstance(doubles, str) else list(doubles)
            ORACLES[key] = rounded(sql, wanted, digits) if wanted else sql
        return fn
    return register


def rounded(sql: str, doubles: list[str], digits: int = 6) -> str:
    swaps = ", ".join(f'round(CAST("{c}" AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS "{c}"' for c in doubles)
    return f"SELECT * REPLACE ({swaps}) FROM (\n{sql}\n) AS result"
