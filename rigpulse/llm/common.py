"""Helpers of the corpus operators: intermediate tables, slices of record batches, linked components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigpulse.session import drop_folder, shared_folder

#: Bytes of text that one step of a task holds as arrays at a time.
SLICE_BYTES = 1 << 20


class Workspace:
    """A folder of intermediate tables of one operator call below ``spark.checkpoint.dir``.

    ``table`` writes a frame once and reads it back, which cuts its lineage and survives lost executors; ``drop``
    removes tables that were only steps.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def folder(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count}-{name}"

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = self.folder(name)
        df.write.parquet(path, compression=compression)
        made = self.spark.read.schema(df.schema).parquet(path)
        made._stored_at = path
        return made

    def drop(self, *tables: DataFrame) -> None:
        for made in tables:
            drop_folder(self.spark, made._stored_at)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` (text or bytes) holds about ``most`` bytes in each; one row may exceed it."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        start, held = 0, 0
        for i, n in enumerate(pc.binary_length(values).fill_null(0).to_pylist()):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def components(ws: Workspace, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): each node of ``links`` (a, b: long) with the smallest node that its links reach.

    Alternating stars: each round hangs the larger neighbours of a node on the smallest one, then the smaller ones,
    until the links are stars. A round is two aggregates with map-side combine and two equi-joins, so a node with very
    many links is never gathered; each round's links are written before the next one reads them.
    """
    edges = ws.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                     .where("u <> v").distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        after = ws.table(small, "links")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        ws.drop(edges)
        edges = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
