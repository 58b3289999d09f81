"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from rigpulse.functions.columns import safe_segment

_INT_MAX = 2**31 - 1


def narrow_types(df: DataFrame) -> DataFrame:
    """double to float, and bigint to int where every value fits (one pass over the bigint columns)."""
    whole = [f.name for f in df.schema if isinstance(f.dataType, LongType)]
    fits: set[str] = set()
    if whole:
        extent = df.agg(*[F.max(F.abs(F.col(f"`{c}`").cast("decimal(20,0)"))).alias(f"m{i}")
                          for i, c in enumerate(whole)]).first()
        fits = {c for i, c in enumerate(whole) if extent[i] is None or extent[i] <= _INT_MAX}
    columns = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DoubleType):
            c = c.cast("float")
        elif field.name in fits:
            c = c.cast("int")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    narrow_types(df).write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str, by: str = "excavator_id", mode: str = "overwrite") -> None:
    """One folder per machine, its name made safe for a path.

    ``overwrite`` replaces the folders of the machines in ``df`` and leaves those of all others, also when the job fails.
    """
    (df.withColumn(by, safe_segment(by)).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(by).parquet(path))
