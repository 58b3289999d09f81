"""Scans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

FILE, ORDER = "_file", "_ingest_order"


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType, **options: str) -> DataFrame:
    """CSV with a header and a declared schema; NaN becomes null."""
    return nan_to_null(spark.read.schema(schema).options(header=True, enforceSchema=False, **options).csv(path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def read_reference(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A reference sheet exported as CSV or Parquet."""
    return read_csv(spark, path, schema) if path.endswith(".csv") else spark.read.schema(schema).parquet(path)


def read_telemetry(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """All ``*telemetry*.csv`` below ``root`` in one scan, with the file and the order inside it.

    Files may have different headers, so columns are matched by name: absent ones become null, and those that the schema
    does not name stay as text.
    """
    reader = spark.read.options(header=True, pathGlobFilter="*telemetry*.csv", columnNameOfCorruptRecord="_bad")
    files = [r.path for r in reader.format("binaryFile").load(root).select("path").toLocalIterator()]
    layouts: dict[tuple[str, ...], list[str]] = {}
    for file in files:
        layouts.setdefault(tuple(spark.read.option("header", True).csv(file).columns), []).append(file)
    return union_frames([_read_layout(spark, paths, names, schema) for names, paths in layouts.items()])


def _read_layout(spark: SparkSession, paths: list[str], names: Sequence[str], schema: StructType) -> DataFrame:
    """One scan of the files that share a header."""
    text = spark.read.option("header", True).schema(", ".join(f"`{n}` string" for n in names)).csv(paths)
    present = {n.strip(): n for n in names}
    columns = []
    for field in schema:
        value = F.col(f"`{present[field.name]}`").try_cast(field.dataType) if field.name in present else F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    columns += [F.col(f"`{raw}`").alias(name) for name, raw in present.items() if name not in schema.names]
    return nan_to_null(text.select(
        *columns,
        F.col("_metadata.file_path").alias(FILE),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        .alias(ORDER),
    ))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Aggregates and comparisons treat NaN as a value, so it must not enter."""
    real = {f.name for f in df.schema if isinstance(f.dataType, DoubleType | FloatType)}
    if not real:
        return df
    return df.select(*[
        F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if c in real else F.col(f"`{c}`") for c in df.columns
    ])


def union_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column absent from a frame is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
